"""BPE encoding and decoding with reuse of content-defined chunks."""

from __future__ import annotations

import json
import os
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.chunks import rolling
from folioflow.llm.common import runs

BLOCK_CHARS = 750_000
CHUNK_BITS = 11
KEPT_PIECES = 75_000
GROUP = 4096
SPACES = " \t\n\v\f\r"
# Signs at the end of a word that may be parted from it, where the tokenizer does so.
TAIL = ".,!?;:#*$%&()=+-"
_SPACE = np.zeros(256, bool)
_SPACE[[ord(c) for c in SPACES]] = True
WINDOW = 32


def chunk_ends(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Ends of the chunks of texts laid end to end in data. A chunk begins with the first word after a place where the rolling
    hash of the WINDOW bytes before has its top CHUNK_BITS bits zero; the text's start and the bytes near it do not matter."""
    if not len(data):
        return np.unique(ends)
    space = _SPACE[data]
    begins = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    marks = np.flatnonzero(rolling(data) < np.uint32(1 << (32 - CHUNK_BITS))) + 1
    at = np.searchsorted(begins, marks)
    starts = np.concatenate(([0], ends))
    found = np.searchsorted(ends, marks, side="right")
    deep = (at < len(begins)) & (marks - starts[np.minimum(found, len(starts) - 1)] >= WINDOW)
    return np.unique(np.concatenate((begins[at[deep]], ends)))


def taken(values: np.ndarray, offsets: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slices of values that offsets bound, one after the other in the order chosen, and their sizes."""
    sizes = np.diff(offsets)[chosen]
    inner = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return values[np.repeat(offsets[:-1][chosen], sizes) + inner], sizes


class Coder:
    """Encodes texts with a file of the tokenizers library and, if asked for, decodes them."""

    def __init__(self, model: str, decoded: bool = True):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(model)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        spec = json.loads(model)
        self.plain = spec.get("decoder") is None
        self.decoded = decoded
        self.names = [self.tokenizer.id_to_token(i) for i in range(self.tokenizer.get_vocab_size(with_added_tokens=True))]
        added = spec.get("added_tokens", [])
        fixed = [t for t in added if not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"])]
        self.between = (fixed[0]["content"], fixed[0]["id"]) if fixed else None
        self.starts = "".join({t["content"][0] for t in added})
        self.known: dict[str, bytes] = {}  # pieces -> ids as bytes
        self.tails: dict[str, bool] = {}
        self.ends: dict[tuple[str, str], bool] = {}
        self.by_words = self.plain and self.parts_at_spaces()
        letters = [chr(c) for c in range(65, 91)]
        self.lowers = self.by_words and self.ids_of([f"{c}a{c}" for c in letters]) == self.ids_of([f"{c}a{c}".lower() for c in letters])
        # whether runs of a to z reach the model as they are
        tried = [c * n for c in map(str.lower, letters) for n in (1, 2, 3, 20)] + [n for n in self.names if n and n.isascii() and n.isalpha() and n.islower()][:2000]
        self.straight = self.by_words and self.ids_of(tried) == [self.model_ids(t) for t in tried]

    def ids_of(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def model_ids(self, piece: str) -> list[int]:
        return [t.id for t in self.tokenizer.model.tokenize(piece)]

    def parts_at_spaces(self) -> bool:
        """Whether white space parts texts for this tokenizer: tried with every ASCII space, alone and in runs, between, before and
        behind letters, digits, signs, marks and the added tokens."""
        sides = ["a", "B", "é", "日", "9", ".", "'", "'s", "s", "-", "#", "́", "x" * 9, *(t.content for t in self.tokenizer.get_added_tokens_decoder().values())]
        between = [*SPACES, "  ", " \n", "\t\t\t"]
        alone = dict(zip(sides, self.ids_of(sides)))
        tried = [(a + s + b, alone[a] + alone[b]) for a in sides for b in sides for s in between]
        tried += [(s + a + s, alone[a]) for a in sides for s in between] + [(s, []) for s in between]
        return self.ids_of([t for t, _ in tried]) == [want for _, want in tried]

    def parts_tail(self, tail: str) -> bool:
        """Whether these signs behind a letter or digit have the ids of their own, tried once for each kind of tail."""
        good = self.tails.get(tail)
        if good is None:
            sides = ["a", "z", "é", "日", "9", "of"]
            alone = self.ids_of([*sides, tail])
            good = self.ids_of([x + tail for x in sides]) == [x + alone[-1] for x in alone[:-1]]
            self.tails[tail] = good
        return good

    def ends_apart(self, last: str, tail: str) -> bool:
        """Whether these signs part from this letter or digit, tried once for each such pair: what normalisation makes of a letter may
        end in a mark that signs join."""
        good = self.ends.get((last, tail))
        if good is None:
            both, alone, sign = self.ids_of(["a" + last + tail, "a" + last, tail])
            only, bare = self.ids_of([last + tail, last])
            good = both == alone + sign and only == bare + sign
            if len(self.ends) >= KEPT_PIECES:
                self.ends.clear()
            self.ends[last, tail] = good
        return good

    def pieces_of(self, word: str) -> tuple[str, ...]:
        """A word without what the tokenizer parts from it and, if ASCII, in lower case, where the tokenizer does so."""
        for c in self.starts:
            if c in word:  # may hold an added token
                return (word,)
        body = word.rstrip(TAIL)
        tail = word[len(body) :]
        if tail and not (body and body[-1].isalnum() and self.parts_tail(tail) and (body[-1].isascii() or self.ends_apart(body[-1], tail))):
            body, tail = word, ""
        if self.lowers and body.isascii():
            body = body.lower()
        return (body, tail) if tail else (body,)

    def learn(self, pieces: set) -> None:
        """Encode pieces that are not known yet: runs of a to z by the library's model alone where this gives the same, the others
        many together with an added token between them, which the library splits off before
        anything else; pieces that may hold such a token are encoded alone."""
        new = [p for p in pieces if p not in self.known]
        if self.straight:
            tokenize = self.tokenizer.model.tokenize
            for p in [p for p in new if p.isalpha() and p.isascii() and p.islower()]:
                self.known[p] = array("i", [t.id for t in tokenize(p)]).tobytes()
            new = [p for p in new if p not in self.known]
        alone = [p for p in new if self.between is None or any(c in p for c in self.starts)]
        lonely = set(alone)
        found = [np.array(x, np.int32) for x in self.ids_of(alone)]
        group = [p for p in new if p not in lonely]
        for a in range(0, len(group), GROUP):
            part = group[a : a + GROUP]
            ids = np.array(self.ids_of([self.between[0].join(part)])[0], np.int32)
            bounds = [-1, *np.flatnonzero(ids == self.between[1]).tolist(), len(ids)]
            found += [ids[x + 1 : y] for x, y in zip(bounds, bounds[1:])]
        for p, x in zip([*alone, *group], found, strict=True):
            self.known[p] = x.tobytes()

    def words_of(self, words: list[str]) -> list[bytes]:
        """Ids as bytes of each word. What is kept of pieces is bounded by KEPT_PIECES and what one run needs."""
        split = [self.pieces_of(w) for w in words]
        if len(self.known) > KEPT_PIECES:
            self.known.clear()
        self.learn({p for s in split for p in s})
        known = self.known
        return [known[s[0]] if len(s) == 1 else known[s[0]] + known[s[1]] for s in split]

    def spelt(self, flat: np.ndarray, sizes: np.ndarray) -> pa.Array:
        """The names of the tokens of each text, one space between them."""
        at = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))
        return pc.binary_join(pa.ListArray.from_arrays(at, pa.array(self.names, pa.string()).take(pa.array(flat))), " ")

    def code(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray, pa.Array | None]:
        """Ids of all texts one after the other, their number in each text, and the decoded texts, None if not asked for."""
        return self.by_chunks(texts) if self.by_words else self.whole(texts)

    def whole(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray, pa.Array | None]:
        """By the library; equal texts once."""
        told = texts.dictionary_encode()
        ids = self.ids_of(told.dictionary.to_pylist())
        offsets = np.cumsum([0, *map(len, ids)])
        flat, sizes = taken(np.array([i for x in ids for i in x], np.int32), offsets, told.indices.to_numpy())
        if not self.decoded or self.plain:
            return flat, sizes, self.spelt(flat, sizes) if self.decoded else None
        decoded = pa.array([self.tokenizer.decode(x, skip_special_tokens=False) for x in ids], pa.string())
        return flat, sizes, decoded.take(told.indices)

    def by_chunks(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray, pa.Array | None]:
        """Equal chunks are encoded once: their words, each different one once, by the library.

        A join of two chunks is checked by encoding what stands around it, the last word before and the first behind, as
        one. Where the ids are not those of both, the window is widened to the whole texts with this join, which the
        library encodes."""
        texts = pa.array(texts.to_pylist(), pa.string()) if texts.offset else texts
        offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1)
        buffer = texts.buffers()[2] or pa.py_buffer(b"")
        data = np.frombuffer(buffer, np.uint8, int(offsets[-1]))
        ends = chunk_ends(data, offsets[1:].astype(np.int64))
        ends = ends[ends > 0]
        bounds = np.concatenate(([0], ends)).astype(np.int32)
        chunks = pa.StringArray.from_buffers(len(ends), pa.py_buffer(bounds.tobytes()), buffer).dictionary_encode()
        which = chunks.indices.to_numpy()
        split = pc.ascii_split_whitespace(chunks.dictionary)
        words = split.flatten().dictionary_encode()
        ids = self.words_of(words.dictionary.to_pylist())
        id_bounds = np.cumsum([0, *map(len, ids)]) // 4
        flat = np.frombuffer(b"".join(ids), np.int32)
        counts = np.diff(id_bounds)
        word_of, full = words.indices.to_numpy(), counts[words.indices.to_numpy()] > 0
        kept_before = np.concatenate(([0], np.cumsum(full)))
        word_bounds = kept_before[split.offsets.to_numpy() - split.offsets[0].as_py()]  # of the words with ids in each chunk
        sequence, per_chunk = taken(word_of[full], word_bounds, which)

        text_of = np.searchsorted(offsets[1:], ends - 1, side="right")
        joins = np.flatnonzero(text_of[1:] == text_of[:-1])  # chunk j goes on in chunk j + 1
        wrong = self._joins_that_differ(joins, bounds, data, words.dictionary, word_of, split, which, ids)
        per_text = np.bincount(text_of, per_chunk, len(texts)).astype(np.int64) if len(text_of) else np.zeros(len(texts), np.int64)
        out, sizes = taken(flat, id_bounds, sequence)
        at = np.cumsum(np.concatenate(([0], per_text)))
        ids_before = np.concatenate(([0], np.cumsum(sizes)))[at]
        sizes = np.diff(ids_before)
        if len(wrong):
            again = np.unique(text_of[wrong])
            repaired = self.ids_of([texts[int(i)].as_py() for i in again])
            parts = [out[a:b] for a, b in zip(ids_before[:-1], ids_before[1:])]
            for i, x in zip(again.tolist(), repaired):
                parts[i] = np.array(x, np.int32)
            out, sizes = np.concatenate(parts), np.array([len(p) for p in parts])
        return out, sizes, self.spelt(out, sizes) if self.decoded else None

    def _joins_that_differ(self, joins, bounds, data, words, word_of, split, which, ids) -> np.ndarray:
        """The joins at which the words around, encoded as one with the space between them, have other ids than each for itself."""
        if not len(joins):
            return joins
        first = split.offsets.to_numpy() - split.offsets[0].as_py()
        texts = words.to_pylist()
        left, right = which[joins], which[joins + 1]
        behind = bounds[joins + 1]  # the space before this place parts the words
        tried: dict = {}
        for l, r, at in zip(left.tolist(), right.tolist(), behind.tolist()):
            a = first[l + 1] - 1
            while a >= first[l] and not texts[word_of[a]]:
                a -= 1
            b = first[r]
            while b < first[r + 1] - 1 and not texts[word_of[b]]:
                b += 1
            w = at
            while w > 0 and _SPACE[data[w - 1]]:
                w -= 1
            tried[(l, r)] = (int(word_of[a]) if a >= first[l] else -1, data[w:at].tobytes().decode("ascii"), int(word_of[b]))
        kinds = list(set(tried.values()))
        got = self.ids_of([(texts[a] if a >= 0 else "") + s + texts[b] for a, s, b in kinds])
        good = {k: np.array(x, np.int32).tobytes() == (ids[k[0]] if k[0] >= 0 else b"") + ids[k[2]] for k, x in zip(kinds, got)}
        return joins[[not good[tried[p]] for p in zip(left.tolist(), right.tolist())]]


def encode_decode(docs: DataFrame, tokenizer_path: str, keep: tuple = (), decoded: bool = True) -> DataFrame:
    """n_tokens, ids (array<int>) and decoded (string, unless decoded is False) of every row of docs(doc_id, text), with the columns of `keep`.

    The ids are those of the tokenizers library for the file at tokenizer_path without special tokens, truncation
    or padding; decoded is its decode() of them with special tokens kept. Chunks are reused within a task for tokenizers that
    part texts at white space, which is tried (parts_at_spaces); others get the texts whole. A null
    or empty text has no ids and decodes to ''. Repeated rows each give a row; an empty table gives none. A worker sends back the
    columns of the result only: a text that is not kept stays with it."""
    with open(tokenizer_path, encoding="utf-8") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())  # one vocabulary file
    keep = tuple(c for c in keep if c != "doc_id")
    base = docs.select("doc_id", *keep, F.col("text").alias("text_to_encode"))

    def run(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks fill the cores
        coder = Coder(model.value, decoded)
        for batch in batches:
            for start, texts in runs(batch.column(batch.num_columns - 1), BLOCK_CHARS):
                flat, sizes, told = coder.code(texts)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(flat))
                made = {"n_tokens": pa.array(sizes.astype(np.int64)), "ids": lists} | ({"decoded": told} if decoded else {})
                kept = batch.slice(start, len(texts))
                yield pa.RecordBatch.from_arrays([*kept.columns[:-1], *made.values()], names=[*batch.schema.names[:-1], *made])
                pa.default_memory_pool().release_unused()

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields[:-1])
    return base.mapInArrow(run, f"{fields}, n_tokens long, ids array<int>" + ", decoded string" * decoded)
