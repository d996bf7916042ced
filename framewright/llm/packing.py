"""Best-fit packing by a plan over the histogram of lengths.

Texts become pieces of at most `width` tokens. The driver sees only the histogram, which has at
most `width` entries for any corpus: best-fit decreasing runs over counts (all equal bins and all
equal lengths at once), and gives patterns of lengths with a number of sequences each. Pieces
then take the planned slots: a piece's rank within its length falls in one interval of ranks of
one pattern position, which names sequence and offset.

Null and empty texts: one piece of one token (the closing id). Texts over `width` tokens are cut
from the end, so that only their first piece may be shorter. Null ids and repeated rows are packed as
often as they occur, told apart by a salt. Ties in length go by id, piece and checksum. Very long texts
are encoded one at a time. Empty table: no rows. Other columns, whatever their names, do not matter.
"""

from __future__ import annotations

import functools
import json
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm import common
from framewright.llm.common import ranked, stored

#: Pre-tokens that a worker remembers; beyond it starts anew.
CACHE = 300_000


class WordCache:
    """Ids of whole texts as the tokenizer itself gives them, mostly from the ids of their pre-tokens.

    Byte-level BPE never merges across pre-tokens, so a text's ids are its pre-tokens' ids in
    order; each distinct pre-token is encoded once by the tokenizer. Texts of plain ASCII and Latin
    letters, where the classes need no Unicode tables, are split by a plainer pattern. A text that
    holds one of the vocabulary's added tokens is encoded whole, and so is every text if the vocabulary
    has a normalizer, adds other tokens or splits in another way than PATTERN.
    """

    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    LATIN = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u01ba"

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            form = json.load(f)
        way, model = form.get("pre_tokenizer") or {}, form.get("model") or {}
        plain_way = way.get("type") == "ByteLevel" and not way.get("add_prefix_space") and way.get("use_regex", True) and model.get("type") == "BPE"
        self.cached = bool(plain_way and not form.get("normalizer") and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix"))
        added = [t["content"] for t in form.get("added_tokens") or ()]
        self.added = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))).search if added else lambda t: None
        self.split = regex.compile(self.PATTERN).findall
        self.plain = re.compile(self.PATTERN.replace("^\\s\\p{L}\\p{N}", f"^\\s0-9{self.LATIN}").replace("\\p{L}", f"[{self.LATIN}]").replace("\\p{N}", "[0-9]")).findall
        self.other = re.compile(f"[^\t\n\r -~{self.LATIN}]").search
        self.known: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _learn(self, new: list[str]) -> None:
        """Ids of new pre-tokens. Words that begin with a blank are encoded as one text, which splits at each blank again."""
        known = self.known
        spaced = [p for p in new if p[0] == " " and p[1:].isalpha()]
        text = "".join(spaced)
        if spaced and not self.added(text):
            e = self.tokenizer.encode(text, add_special_tokens=False)
            word, data = np.array(e.word_ids, np.int64), np.array(e.ids, "<u4").tobytes()
            if word[-1] + 1 == len(spaced):  # else a word is split again
                edges = (4 * np.searchsorted(word, np.arange(len(spaced) + 1))).tolist()
                known.update((p, data[i:j]) for p, i, j in zip(spaced, edges[:-1], edges[1:], strict=True))
                new = [p for p in new if p not in known]
        for p, e in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False), strict=True):
            known[p] = array("I", e.ids).tobytes()

    def ids(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        parts, known = [None if not self.cached or self.added(t) else (self.split if self.other(t) else self.plain)(t) for t in texts], self.known
        seen = set().union(*(x for x in parts if x))
        new = list(seen.difference(known))
        if len(known) + len(new) > CACHE:
            known.clear()
            new = list(seen)
        self._learn(new)
        return [self._whole(t) if x is None else b"".join(map(known.__getitem__, x)) for t, x in zip(texts, parts, strict=True)]


@functools.cache
def _cache(path: str) -> WordCache:
    """One for a worker process, kept from task to task."""
    return WordCache(path)


def pieces(docs: DataFrame, vocabulary: str, width: int = 2048, closing: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces with their ids: id, piece, start, length, ids_crc32, ids (binary, uint32 little-endian)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        cache, end = _cache(vocabulary), np.uint32(closing).astype("<u4").tobytes()
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                rows: list[tuple] = []
                for key, ids in zip(b.column(0).to_pylist(), cache.ids([t or "" for t in b.column(1).to_pylist()]), strict=True):
                    ids += end
                    n = len(ids) // 4
                    cuts = [0, *range(n % width or width, n + 1, width)]
                    for k, (i, j) in enumerate(zip(cuts, cuts[1:], strict=False)):
                        part = ids[4 * i : 4 * j]
                        rows.append((key, k, i, j - i, zlib.crc32(part), part))
                cols = list(zip(*rows, strict=True)) or [()] * 6
                yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, [b.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()], strict=True)], names=[id_col, "piece", "start", "length", "ids_crc32", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(common.trimmed(run), f"{id_col} {kind}, piece int, start long, length long, ids_crc32 long, ids binary")


def plan(histogram: dict[int, int], width: int) -> list[tuple[int, int, int, int, int]]:
    """Slots as (length, first rank, end rank, first sequence, offset): ranks follow sequences.

    Best-fit decreasing over counts. State: bins by remaining room, as groups of equal bins. For
    the next shorter length, the tightest groups with room take one piece for each bin until the
    length is used up; what is left opens new bins, each with as many as fit.
    """
    groups: dict[int, list[tuple[int, tuple[int, ...]]]] = {}  # room -> [(bins, lengths)]
    rooms = np.zeros(width + 1, bool)

    def put(room: int, bins: int, lengths: tuple[int, ...]) -> None:
        if bins:
            groups.setdefault(room, []).append((bins, lengths))
            rooms[room] = True

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            fits = np.flatnonzero(rooms[length:])
            if not len(fits):
                break
            room = length + int(fits[0])
            bins, lengths = groups[room].pop()
            rooms[room] = bool(groups[room])
            used = min(bins, left)
            put(room, bins - used, lengths)
            put(room - length, used, (*lengths, length))
            left -= used
        each = width // length
        put(width - each * length, left // each, (length,) * each)
        if left % each:
            put(width - left % each * length, 1, (length,) * (left % each))
    out, rank, sequence = [], dict.fromkeys(histogram, 0), 0
    for room in sorted(groups):
        for bins, lengths in groups[room]:
            offset = 0
            for x in lengths:
                out.append((x, rank[x], rank[x] + bins, sequence, offset))
                rank[x] += bins
                offset += x
            sequence += bins
    return out


def pack(pieces: DataFrame, width: int = 2048, id_col: str = "doc_id") -> DataFrame:
    """Add sequence_id and offset to the pieces (stored, without a second pass over texts)."""
    # the histogram has at most `width` rows
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    slots = pieces.sparkSession.createDataFrame(plan(counts, width), "length long, first long, end long, sequence long, offset long")
    salt = [F.col("salt")] if "salt" in pieces.columns else []
    placed = ranked(pieces, ["length"], [F.col(id_col), F.col("piece"), F.col("ids_crc32"), *salt], "rank", lanes=32)
    # a few slots for each of at most `width` lengths, so its size does not follow the corpus
    placed = placed.join(F.broadcast(slots), "length").filter("rank >= first and rank < end")
    return placed.select(*[c for c in pieces.columns if c != "salt"], (F.col("sequence") + F.col("rank") - F.col("first")).alias("sequence_id"), "offset")


def pack_documents(docs: DataFrame, vocabulary: str, width: int = 2048) -> DataFrame:
    """Tokenise, plan and place; the ids themselves are kept out of the shuffle."""
    cut = pieces(docs, vocabulary, width).drop("ids").withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(61)).cast("int"))
    return pack(stored(cut, "pieces"), width)
