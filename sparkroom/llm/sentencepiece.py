"""SentencePiece encoding and decoding with a shared-prefix Viterbi search.

Texts are marked (a blank becomes "▁", one goes before the text) and cut into
marked words before each run of marks, and inside words between a letter or digit
and a mark that no piece of the model holds side by side, so that no piece can
cross the cut. The distinct new words of a batch are sorted, which is the
depth-first order of their trie; going from one word to the next, the forward
states of the prefix they share are kept and only the rest is computed.

Unigram models: a forward state is the best score of a prefix and the piece it
ends with. BPE models: the best sum of scores isn't what the library gives, as
its merges are greedy. There the lattice allows a piece after another only if
the library's merges leave that pair as it is; exactly one path through such a
lattice exists for each prefix, and it is the library's result (merges that
cross a boundary would also cross it in the pair alone). The forward state is
then the last piece of that path.

A Python worker remembers the words it has met, ``MEMORY_WORDS`` at most, for all
tasks that it runs; when the memory is full it starts anew.

Defined results: a null or empty text has no ids; decoding drops the mark put
before the text; characters without a piece are their bytes' pieces, or the
unknown piece where the model has none; rows that repeat are each encoded;
other columns are carried along, save ones named ``ids`` or ``decoded``, which
are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkroom.llm.memory import PieceMemory

MARK = "▁"
MEMORY_WORDS = 500_000
MEMORY_PAIRS = 300_000
#: Texts encoded together.
TEXTS = 256
#: Latin letters and digits, and ASCII marks that may stand after them.
_LETTER = re.compile("[0-9A-Za-zÀ-ÖØ-öø-ɏ]")
_ASCII_MARKS = [chr(c) for c in range(33, 127) if not chr(c).isalnum()]
_CUT = re.compile(f"(?<=[^{MARK}])(?={MARK})")


class Pieces:
    """What a model file holds, as read through the library."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_file=path)
        n = lib.get_piece_size()
        self.unknown = lib.unk_id()
        self.text = [lib.id_to_piece(i) for i in range(n)]
        self.score = [lib.get_score(i) for i in range(n)]
        self.byte = [-1] * 256
        self.byte_of: dict[int, int] = {}
        self.id: dict[str, int] = {}
        for i in range(n):
            if lib.is_byte(i):
                self.byte[value := int(self.text[i][3:-1], 16)] = i
                self.byte_of[i] = value
            elif not (lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i)):
                self.id[self.text[i]] = i
        self.silent = {i for i in range(n) if lib.is_control(i)}
        self.longest = max(map(len, self.id), default=1)
        # merges are numbered by falling score in a BPE model
        own = [self.score[i] for i in self.id.values() if len(self.text[i]) > 1 and self.score[i] > -1e8]
        self.bpe = bool(own) and all(float(s).is_integer() for s in own)


class Encoder:
    def __init__(self, path: str, memory: int = MEMORY_WORDS) -> None:
        self.pieces = p = Pieces(path)
        self.known = PieceMemory(memory)
        self.pairs: dict[str, bool] = {}
        self.floor = min(p.score, default=0.0) - 10.0
        joined = {piece[i] for piece in p.id for i in range(1, len(piece)) if _LETTER.match(piece[i - 1])}
        apart = [c for c in _ASCII_MARKS if c not in joined]
        self.ends = f"({_LETTER.pattern})([{re.escape(''.join(apart))}])" if apart else None
        # finds the pieces that end at a place, the longest first
        self.finder = ahocorasick.Automaton()
        for piece in p.id:
            self.finder.add_word(piece, piece)
        self.finder.make_automaton()
        self.special = np.zeros(len(p.text), bool)
        # bytes of ASCII are characters; others need their neighbours
        self.special[[p.unknown, *p.silent, *(i for i, b in p.byte_of.items() if b > 127)]] = True
        # pieces as they show inside a text, then as they show at its start
        plain = [chr(p.byte_of[i]) if i in p.byte_of else t.replace(MARK, " ") for i, t in enumerate(p.text)]
        self.shown = pa.array(plain + [t.removeprefix(" ") for t in plain], pa.string())

    @classmethod
    @lru_cache(maxsize=2)
    def shared(cls, path: str) -> Encoder:
        """One encoder for all tasks that a worker runs."""
        return cls(path)

    def ids_of(self, piece: str) -> list[int]:
        p = self.pieces
        if (i := p.id.get(piece)) is not None:
            return [i]
        own = [p.byte[b] for b in piece.encode("utf-8", "replace")]
        return [p.unknown] if -1 in own else own

    def merged(self, text: str) -> list[str]:
        """The pieces that greedy merging of a short text gives."""
        ids, score, parts = self.pieces.id, self.pieces.score, list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                k = ids.get(parts[i] + parts[i + 1])
                if k is not None and (best is None or score[k] > best):
                    best, at = score[k], i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def allowed(self, left: str, right: str) -> bool:
        """Whether merging leaves a pair of pieces as it is."""
        key = f"{left}\0{right}"
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) >= MEMORY_PAIRS:
                self.pairs.clear()
            found = self.pairs[key] = self.merged(left + right) == ([left, right] if left else [right])
        return found

    def _extend_bpe(self, word: str, last: list[str]) -> None:
        """The last piece of the one allowed path to every end that ``last`` lacks;
        ``last`` begins with the empty path. Ends of the shared prefix are there
        already and are passed over."""
        allowed, have = self.allowed, len(last)
        for end, piece in self.finder.iter(word):
            end += 1
            if end < have:
                continue
            while have < end:  # no piece fits there: a character without one
                last.append(word[have - 1])
                have += 1
            if have == end and allowed(last[end - len(piece)], piece):
                last.append(piece)
                have += 1
        last.extend(word[have - 1 :])

    def _step_unigram(self, word: str, end: int, last: list, best: list[float]) -> str:
        known, score = self.pieces.id, self.pieces.score
        found, top = word[end - 1], -float("inf")
        for start in range(max(0, end - self.pieces.longest), end):
            piece = word[start:end]
            k = known.get(piece)
            if k is None and start < end - 1:
                continue
            s = best[start] + (self.floor if k is None else score[k])
            if s > top:
                found, top = piece, s
        best[end:] = [top]
        return found

    def segment(self, words: list[str]) -> Iterator[tuple[str, list[str]]]:
        """Pieces of sorted distinct words; forward states of the prefix that a
        word shares with the one before are used again."""
        before, last, best = "", [""], [0.0]
        for word in words:
            same = 0
            for a, b in zip(before, word):
                if a != b:
                    break
                same += 1
            del last[same + 1 :], best[same + 1 :]
            if self.pieces.bpe:
                self._extend_bpe(word, last)
            else:
                for end in range(same + 1, len(word) + 1):
                    last.append(self._step_unigram(word, end, last, best))
            out, at = [], len(word)
            while at:
                out.append(last[at])
                at -= len(last[at])
            yield word, out[::-1]
            before = word

    def learn(self, words: list[str]) -> None:
        """Work out the marked words not met before."""
        new = sorted(self.known.missing(words))
        if new:
            found = [list(chain.from_iterable(map(self.ids_of, parts))) for _, parts in self.segment(new)]
            self.known.keep(new, np.fromiter(chain.from_iterable(found), np.uint32), np.fromiter(map(len, found), np.int64, len(found)))

    def marked(self, texts: pa.Array) -> pa.ListArray:
        """The marked words of texts without null."""
        odd = pc.match_substring_regex(texts, f"^$|^ | $|  |[\0{MARK}]")
        cut = pc.replace_substring_regex(texts, self.ends, "\\1\0\\2") if self.ends else texts
        lists = pc.split_pattern(pc.binary_join_element_wise(MARK, pc.replace_substring(cut, " ", f"\0{MARK}"), ""), "\0")
        if not pc.any(odd).as_py():
            return lists
        # runs of marks belong to the word after them; an empty text has no word
        some = [_CUT.split(MARK + t.replace(" ", MARK)) if t else [] for t in texts.filter(odd).to_pylist()]
        whole = pa.concat_arrays([lists.filter(pc.invert(odd)), pa.array(some, lists.type)])
        odd = odd.to_numpy(zero_copy_only=False)
        return whole.take(pa.array(np.argsort(np.argsort(odd, kind="stable"), kind="stable")))

    def encode_arrow(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and the place where each begins, the
        end of the last one included."""
        lists = self.marked(pc.fill_null(texts, ""))
        named = lists.flatten().dictionary_encode()
        words = named.dictionary.to_pylist()
        self.learn(words)
        ends = np.concatenate(([0], np.cumsum(pc.list_value_length(lists).to_numpy())))
        ids, at = self.known.ids(words, named.indices.to_numpy(), ends)
        return ids.view(np.int32), at

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        ids, at = self.encode_arrow(pa.array(texts, pa.string()))
        return np.split(ids, at[1:-1]) if texts else []

    def decode_arrow(self, ids: np.ndarray, at: np.ndarray) -> pa.Array:
        """The texts of ids as ``encode_arrow`` gives them."""
        odd = np.concatenate(([0], np.cumsum(self.special[ids])))
        odd = odd[at[1:]] != odd[at[:-1]]
        first = ids.copy()
        first[at[:-1][at[:-1] < at[1:]]] += len(self.special)
        text = pc.binary_join(pa.ListArray.from_arrays(pa.array(at, pa.int32()), self.shown.take(pa.array(first))), "")
        if not odd.any():
            return text
        own = pa.array([self.decode(ids[at[i] : at[i + 1]]) for i in np.flatnonzero(odd)], pa.string())
        return pc.replace_with_mask(text, pa.array(odd), own)

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: pieces and runs of byte pieces, without the first mark."""
        p, out, run = self.pieces, [], bytearray()
        for i in ids.tolist():
            if i in p.byte_of:
                run.append(p.byte_of[i])
                continue
            if run:
                out.append(run.decode("utf-8", "replace"))
                run = bytearray()
            if i not in p.silent:
                out.append(" ⁇ " if i == p.unknown else p.text[i])
        if run:
            out.append(run.decode("utf-8", "replace"))
        text = "".join(out).replace(MARK, " ")
        return text[1:] if text.startswith(" ") else text


def encode(df: DataFrame, model: str, text: str = "text") -> DataFrame:
    """``df`` with ``ids`` and ``decoded``, the text that the ids give back.

    Arrow batches are cut into slices of ``TEXTS`` rows, so that a task holds the
    words and ids of one slice, whatever the session's batch size; other columns
    pass through as they are."""
    kept = [f for f in df.schema.fields if f.name not in ("ids", "decoded")]
    schema = T.StructType([*kept, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.shared(model)
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                some = batch.slice(at, TEXTS)
                ids, ends = encoder.encode_arrow(some.column(text))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids))
                yield pa.RecordBatch.from_arrays([*[some.column(n) for n in names], lists, encoder.decode_arrow(ids, ends)], [*names, "ids", "decoded"])

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, model: str, ids: str = "ids") -> DataFrame:
    """``df`` with ``decoded``, the text of arrays of ids; null for null."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = Encoder.shared(model)
        for some in batches:
            yield pd.Series([None if x is None else encoder.decode(np.asarray(x)) for x in some], index=some.index, dtype=object)

    return df.withColumn("decoded", F.pandas_udf(run, T.StringType())(F.col(f"`{ids}`")))
