"""Opcode lists as files hold them: big-endian blobs to rows of structs.

A list is a count and its opcodes: id, version, flags, size and parameters. What an
opcode has beside its numbers is put into one struct for all kinds, so that lists of
any mixture are a column of one type."""

from __future__ import annotations

import struct

from pyspark.sql import Column
from pyspark.sql import functions as F

# Numbers of the opcodes that are taken, and the flag of an optional one.
WARP, VIGNETTE, POLYNOMIAL, GAIN = 1, 3, 8, 9
OPTIONAL = 1
#: Those that change samples where they stand.
POINTWISE = (VIGNETTE, POLYNOMIAL, GAIN)

#: area: top, left, bottom, right, first plane, planes, row and column pitch; k: the
#: coefficients, or the gains; centre: x and y; grid: rows, columns and planes; step and
#: start: down and across, in parts of the image.
LIST = "array<struct<id:int,optional:boolean,area:array<int>,k:array<double>,centre:array<double>,grid:array<int>,step:array<double>,start:array<double>>>"


def parse(blob: bytes) -> list[dict]:
    """The opcodes of a list in order; unknown ones keep their number alone."""
    (count,) = struct.unpack_from(">I", blob)
    out, at = [], 4
    for _ in range(count):
        code, _, flags, size = struct.unpack_from(">4I", blob, at)
        body = blob[at + 16 : at + 16 + size]
        if len(body) < size:
            raise ValueError("an opcode list ends early")
        op = {"id": code, "optional": bool(flags & OPTIONAL), "area": None, "k": None, "centre": None, "grid": None, "step": None, "start": None}
        if code == VIGNETTE:
            *k, cx, cy = struct.unpack_from(">7d", body)
            op |= {"k": k, "centre": [cx, cy]}
        elif code == POLYNOMIAL:
            *area, degree = struct.unpack_from(">9I", body)
            op |= {"area": area, "k": list(struct.unpack_from(f">{degree + 1}d", body, 36))}
        elif code == GAIN:
            *area, rows, cols = struct.unpack_from(">10I", body)
            step_v, step_h, start_v, start_h, planes = struct.unpack_from(">4dI", body, 40)
            gains = struct.unpack_from(f">{rows * cols * planes}f", body, 76)
            op |= {"area": area, "k": list(gains), "grid": [rows, cols, planes], "step": [step_v, step_h], "start": [start_v, start_h]}
        elif code == WARP:
            (planes,) = struct.unpack_from(">I", body)
            *k, cx, cy = struct.unpack_from(f">{6 * planes + 2}d", body, 4)
            op |= {"k": k, "centre": [cx, cy], "grid": [planes]}
        out.append(op)
        at += 16 + size
    return out


def build(opcodes: list[dict]) -> bytes:
    """The blob of opcodes of ``parse``'s kind."""
    out = [struct.pack(">I", len(opcodes))]
    for op in opcodes:
        code = op["id"]
        if code == VIGNETTE:
            body = struct.pack(">7d", *op["k"], *op.get("centre", (0.5, 0.5)))
        elif code == POLYNOMIAL:
            body = struct.pack(">9I", *op["area"], len(op["k"]) - 1) + struct.pack(f">{len(op['k'])}d", *op["k"])
        elif code == GAIN:
            body = struct.pack(">10I", *op["area"], *op["grid"][:2]) + struct.pack(">4dI", *op["step"], *op["start"], op["grid"][2]) + struct.pack(f">{len(op['k'])}f", *op["k"])
        elif code == WARP:
            body = struct.pack(">I", op["grid"][0]) + struct.pack(f">{len(op['k']) + 2}d", *op["k"], *op["centre"])
        else:
            body = b""
        out.append(struct.pack(">4I", code, 0x01030000, OPTIONAL * bool(op.get("optional")), len(body)) + body)
    return b"".join(out)


def refused(ops: Column, taken: tuple[int, ...] = POINTWISE) -> Column:
    """Numbers of opcodes that are neither taken nor optional, and of warps whose sets of
    coefficients are neither one nor three."""
    odd = lambda o: (o["id"] == WARP) & ~F.get(o["grid"], F.lit(0)).isin(1, 3)
    return F.transform(F.filter(ops, lambda o: (~o["id"].isin(*taken) & ~o["optional"]) | (o["id"].isin(*taken) & odd(o))), lambda o: o["id"])


def _clamp(v: str) -> str:
    return f"least(greatest({v}, 0D), 1D)"


def apply(v: str, ops: str, plane: int) -> Column:
    """The sample in column ``v``, of ``plane`` of a row of y, x, height and width, after
    the list in column ``ops``, clamped after each opcode; null lists change nothing. All
    is one fold inside the plan, as text, for it is long."""
    top, left, bottom, right, first, planes, down, across = (f"o.area[{i}]" for i in range(8))
    inside = f"(y >= {top} and y < {bottom} and x >= {left} and x < {right} and (y - {top}) % {down} = 0 and (x - {left}) % {across} = 0 and {plane} >= {first} and {plane} < {first} + {planes})"
    horner = lambda at: f"aggregate(reverse(o.k), 0D, (s, k) -> s * {at} + k)"
    cx, cy = "(o.centre[0] * (width - 1))", "(o.centre[1] * (height - 1))"
    far = lambda c, size: f"greatest({c}, {size} - 1 - {c})"
    # the farthest corner has radius 1
    radius = f"greatest(power({far(cx, 'width')}, 2) + power({far(cy, 'height')}, 2), 1e-12D)"
    r2 = f"((power(x - {cx}, 2) + power(y - {cy}, 2)) / {radius})"
    vignette = _clamp(f"a * (1 + {r2} * {horner(r2)})")
    # a place in the grid: half a pixel in, in steps from the start, and its last point at most
    at = lambda c, size, i: f"least(greatest(coalesce((({c} + 0.5D) / {size} - o.start[{i}]) / nullif(o.step[{i}], 0), 0D), 0D), o.grid[{i}] - 1D)"
    low = lambda c, size, i: f"cast(least(floor({at(c, size, i)}), greatest(o.grid[{i}] - 2, 0)) as int)"
    layer = f"least({plane}, o.grid[2] - 1)"
    point = lambda dy, dx: f"get(o.k, (least(p.iy + {dy}, o.grid[0] - 1) * o.grid[1] + least(p.ix + {dx}, o.grid[1] - 1)) * o.grid[2] + {layer})"
    mean = f"({point(0, 0)} * (1 - p.fx) + {point(0, 1)} * p.fx) * (1 - p.fy) + ({point(1, 0)} * (1 - p.fx) + {point(1, 1)} * p.fx) * p.fy"
    place = f"named_struct('iy', {low('y', 'height', 0)}, 'ix', {low('x', 'width', 1)}, 'fy', {at('y', 'height', 0)} - {low('y', 'height', 0)}, 'fx', {at('x', 'width', 1)} - {low('x', 'width', 1)})"
    gain = _clamp(f"a * get(transform(array({place}), p -> {mean}), 0)")
    step = f"case when o.id = {POLYNOMIAL} and {inside} then {_clamp(horner('a'))} when o.id = {VIGNETTE} then {vignette} when o.id = {GAIN} and {inside} then {gain} else a end"
    return F.expr(f"case when size({ops}) > 0 then aggregate({ops}, {v}, (a, o) -> {step}) else {v} end")
