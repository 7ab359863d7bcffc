"""Token counts: texts encoded in batches of even size, of which only the lengths are kept."""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import runs

LIMIT = 512
RUN_BYTES = 2_000_000
PART_CHARS = 500_000
BATCH_CHARS = 64_000
KEPT_CHARS = 60_000_000
# What a piece costs to keep besides its characters.
PIECE_COST = 64

_PIECE = re.compile(r"[ \t\n\r]*[^ \t\n\r]+|[ \t\n\r]+")
# White space other than that of _PIECE, as any library may see it; texts that hold some are cut by _CUT.
_OTHER_SPACE = re.compile(r"[^\S \t\n\r]")
_CUT = re.compile(r"(?<=\S)(?=[ \t\n\r])")


def pieces_of(text: str) -> list[str]:
    """The text cut at every place between a character that is no white space and a space, tab or line end."""
    return [p for p in _CUT.split(text) if p] if _OTHER_SPACE.search(text) else _PIECE.findall(text)


def parts_of(text: str, size: int = PART_CHARS):
    """The text in parts of about `size` characters, cut where pieces_of() cuts; one without such a place stays whole."""
    start = 0
    while len(text) - start > size:
        m = _CUT.search(text, start + size)
        if m is None:
            break
        yield text[start : m.start()]
        start = m.start()
    yield text[start:] if start else text


def balanced(items: list[str], size: int):
    """Consecutive slices of items with about `size` characters each."""
    at, have = 0, 0
    for i, item in enumerate(items):
        have += len(item)
        if have >= size:
            yield items[at : i + 1]
            at, have = i + 1, 0
    if at < len(items):
        yield items[at:]


class Lengths:
    """Numbers of tokens by a file of the tokenizers library."""

    def __init__(self, model: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks fill the cores
        self.tokenizer = Tokenizer.from_str(model)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        spec = json.loads(model)
        parts = spec.get("pre_tokenizer") or {}
        added = spec.get("added_tokens", [])
        plain = not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] or re.search(r"\s", t["content"]) for t in added)
        self.by_bytes = spec["model"]["type"] == "BPE" and parts.get("type") == "ByteLevel" and not spec.get("normalizer") and plain and not spec["model"].get("unk_token")
        self.known: dict[str, int] = {}
        self.room = KEPT_CHARS
        self.safe = self.by_bytes and self.cuts_hold([t["content"] for t in added])
        if self.safe:
            # a token of a byte-level vocabulary has one character for each byte
            contents = {t["id"]: t["content"] for t in added}
            size = self.tokenizer.get_vocab_size(with_added_tokens=True)
            self.width = np.array([len((contents[i]).encode()) if i in contents else len(self.tokenizer.id_to_token(i) or "") for i in range(size)], np.int64)

    def lengths(self, texts: list[str]) -> list[int]:
        return [len(e) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def cuts_hold(self, added: list[str]) -> bool:
        """Whether the tokens of a text are those of its pieces: tried with letters, digits, signs, marks, contractions and the
        added tokens on both sides of spaces, tabs and line ends, alone and in runs."""
        sides = ["a", "Zb", "é", "日", "9", ".", "'", "'s", "it's", "-", "́", "\x1c", "½", "x" * 9, *added]
        spaces = [" ", "\t", "\n", "\r\n", "  ", " \n ", "\n\n\n", "\t \t"]
        ends = ["", " ", "\n\n"]
        tried = [(a, s + b + e) for a in sides for s in spaces for b in sides for e in ends]
        whole, left, right = (self.tokenizer.encode_batch_fast(t, add_special_tokens=False) for t in ([a + b for a, b in tried], [a for a, _ in tried], [b for _, b in tried]))
        return all(w.ids == x.ids + y.ids for w, x, y in zip(whole, left, right))

    def learn(self, new: list[str]) -> None:
        """Counts of new pieces. Pieces that begin with white space and end without go to the library one behind the other, in texts of
        even size; the bytes of the tokens tell where each piece ends. The others go alone."""
        joined = [p for p in new if p[0] in " \t\n\r" and not p[-1].isspace()]
        alone = [p for p in new if not (p[0] in " \t\n\r" and not p[-1].isspace())]
        groups = list(balanced(joined, BATCH_CHARS))
        for part in balanced(groups, 16):
            for group, e in zip(part, self.tokenizer.encode_batch_fast(["".join(g) for g in part], add_special_tokens=False)):
                ends = np.cumsum(self.width[np.array(e.ids, np.int64)])
                bounds = np.cumsum([len(p.encode()) for p in group])
                upto = np.searchsorted(ends, bounds, side="right")
                if len(ends) and ends[-1] == bounds[-1] and (ends[upto - 1] == bounds).all():
                    self.known.update(zip(group, np.diff(upto, prepend=0).tolist()))
                else:
                    alone += group
        for group in balanced(alone, BATCH_CHARS):
            self.known.update(zip(group, self.lengths(group)))

    def count(self, texts: list[str]) -> list[int]:
        """The number of tokens of each text. Pieces are counted once and kept while they take KEPT_CHARS at most."""
        if not self.safe:
            return [n for group in balanced(texts, BATCH_CHARS) for n in self.lengths(group)]
        out = []
        for group in balanced(texts, RUN_BYTES):
            if self.room < 0:
                self.known.clear()
                self.room = KEPT_CHARS
            cut = [(i, pieces_of(part)) for i, text in enumerate(group) for part in parts_of(text, PART_CHARS)]
            known = self.known
            new = list({p for _, pieces in cut for p in pieces if p not in known})
            self.room -= sum(map(len, new)) + PIECE_COST * len(new)
            self.learn(new)
            sums = [0] * len(group)
            for i, pieces in cut:
                sums[i] += sum(map(known.__getitem__, pieces))
            out += sums
        return out


_LENGTHS: dict[str, Lengths] = {}


def _of(model: str) -> Lengths:
    """One counter a worker process, which also later tasks use."""
    if model not in _LENGTHS:
        _LENGTHS.clear()
        _LENGTHS[model] = Lengths(model)
    return _LENGTHS[model]


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = LIMIT, keep: tuple = ()) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of every row of docs(doc_id, text), with the columns of `keep`.

    n_tokens is what the tokenizers library gives for the file at tokenizer_path without special tokens added, truncation or
    padding; strings of special tokens inside a text are these tokens, as is its default. A byte-level tokenizer parts texts
    at white space, which is tried first: texts are cut there, and batches of about the same size are encoded. For another tokenizer, or
    where no such place is, texts stay whole. A null or empty text has no bytes and no tokens. Repeated rows each give a row; an empty table
    gives none; columns that are not kept are ignored, whatever their names."""
    with open(tokenizer_path, encoding="utf-8") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())  # one vocabulary file
    names = [c for c in keep if c not in ("doc_id", "text")]
    base = docs.select("doc_id", F.col("text").cast("string").alias("text"), *[F.col(f"`{c}`") for c in names])

    def run(batches):
        counter = _of(model.value)
        for batch in batches:
            for start, texts in runs(batch.column(1), RUN_BYTES):
                same = batch.slice(start, len(texts))
                counts = pa.array(counter.count(texts.to_pylist()), pa.int64())
                yield pa.RecordBatch.from_arrays([same.column(0), *same.columns[2:], pa.array(_bytes(texts)), counts], names=["doc_id", *names, "n_bytes", "n_tokens"])

    fields = {f.name: f.dataType.simpleString() for f in base.schema.fields}
    told = "".join(f", `{c}` {fields[c]}" for c in names)
    out = base.mapInArrow(run, f"doc_id {fields['doc_id']}{told}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def _bytes(texts: pa.StringArray) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
