"""Operator 5, benchmark decontamination: pigeonhole edit matching.

Each test item, normalized, is cut into error budget + 1 pieces: a text within the budget holds one piece unchanged.
Exact hits come from one Aho-Corasick pass over the normalized text; around each hit Myers' bit-parallel search finds
the least edit distance of the item to any stretch of the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilgraph.llm.common import arrow_map, batch_of, per_task, table, texts_of

#: Edits allowed: this share of an item's characters. Items shorter than LEAST characters must be matched whole.
ERROR_SHARE, LEAST = 0.05, 40
#: Normalized item characters that one pass (one broadcast automaton) holds; larger benchmarks take several passes.
PASS_CHARS = 4 << 20
_APART = re.compile(r"[\W_]+")
_OUT = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("distance", pa.int32()), ("stop", pa.int64())])
_KIND = "doc_id long, item_id long, distance int, stop long"


def normalized(text: str) -> str:
    """Lower case, runs of anything but letters and digits as one space, one space at either end."""
    return f" {_APART.sub(' ', text.lower()).strip()} "


def budget(item: str, share: float = ERROR_SHARE) -> int:
    return int(len(item) * share) if len(item) >= LEAST else 0


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """(start, piece): errors + 1 pieces of near equal length that make up the item."""
    n = errors + 1
    ends = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(ends, ends[1:], strict=False)]


class Myers:
    """Bit-parallel edit distance of one pattern to the best stretch of a text (any start, any end)."""

    def __init__(self, pattern: str):
        self.n, self.masks = len(pattern), {}
        for i, c in enumerate(pattern):
            self.masks[c] = self.masks.get(c, 0) | 1 << i

    def best(self, text: str) -> tuple[int, int]:
        """(least distance, smallest end at which it is met)."""
        full, top = (1 << self.n) - 1, 1 << (self.n - 1)
        pv, mv, score, least, end, get = full, 0, self.n, self.n, 0, self.masks.get
        for at, c in enumerate(text, 1):
            eq = get(c, 0)
            xv = eq | mv
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph = mv | ~(xh | pv) & full
            mh = pv & xh
            if ph & top:
                score += 1
            elif mh & top:
                score -= 1
                if score < least:
                    least, end = score, at
            ph = ph << 1 & full
            pv = (mh << 1 & full) | ~(xv | ph) & full
            mv = ph & xv
        return least, end


def matcher(items: list[tuple[int, str]], share: float):
    """text -> [(item_id, distance, stop)] for normalized texts: the least distance of each item within its budget."""
    import ahocorasick

    held = [(item_id, item, budget(item, share)) for item_id, item in items]
    where: dict[str, list[tuple[int, int]]] = {}
    for k, (_, item, errors) in enumerate(held):
        for start, piece in pieces(item, errors):
            where.setdefault(piece, []).append((k, start))
    automaton = ahocorasick.Automaton()
    for piece, uses in where.items():
        automaton.add_word(piece, (len(piece), uses))
    if where:
        automaton.make_automaton()
    search: dict[int, Myers] = {}

    def match(text: str) -> list[tuple[int, int, int]]:
        spans: dict[int, list[list[int]]] = {}
        for end, (size, uses) in automaton.iter(text) if where else ():
            for k, start in uses:
                _, item, errors = held[k]
                lo = max(0, end - size + 1 - start - errors)
                hi = end + 1 + len(item) - start - size + errors
                mine = spans.setdefault(k, [])
                if mine and lo <= mine[-1][1]:  # hits of one item come in order of their ends: stretches join
                    mine[-1] = [min(lo, mine[-1][0]), max(hi, mine[-1][1])]
                else:
                    mine.append([lo, hi])
        out = []
        for k, stretches in sorted(spans.items()):
            item_id, item, errors = held[k]
            found = []
            for lo, hi in stretches:
                if (at := text.find(item, lo, hi)) >= 0:
                    found.append((0, at + len(item)))
                elif errors:
                    distance, end = search.setdefault(k, Myers(item)).best(text[lo:hi])
                    found.append((distance, lo + end))
            if found and min(found)[0] <= errors:
                out.append((item_id, *min(found)))
        return out

    return match


def passes(items: DataFrame, pass_chars: int = PASS_CHARS, item_id: str = "item_id", item_text: str = "text") -> Iterator[list[tuple[int, str]]]:
    """Normalized items in lists of at most `pass_chars` characters (one item at least); null and blank ones are left out."""
    rows = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("text")).where("text is not null")
    held, size = [], 0
    for row in rows.orderBy("item_id", "text").toLocalIterator():
        item = normalized(row["text"])
        if not item.strip():
            continue
        if held and size + len(item) > pass_chars:
            yield held
            held, size = [], 0
        held.append((row["item_id"], item))
        size += len(item)
    if held:
        yield held


def contaminated(docs: DataFrame, items: DataFrame, share: float = ERROR_SHARE, pass_chars: int = PASS_CHARS, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, distance, stop): each document's least edit distance to each item that it holds within the
    item's budget, and where (in the normalized text) that first ends.

    Null or blank texts and items match nothing, null ids are carried, repeated rows give repeated matches, empty
    tables no rows. The documents are never shuffled. Items go to the executors in passes of at most `pass_chars`
    characters, so what is broadcast does not grow with the benchmark.
    """
    spark = docs.sparkSession
    picked = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def one(some: list[tuple[int, str]]) -> DataFrame:
        sent = spark.sparkContext.broadcast(some)

        @per_task
        def task():
            match = matcher(sent.value, share)

            def step(batch: pa.RecordBatch) -> pa.RecordBatch:
                hits = [(doc, *m) for doc, body in zip(batch.column("doc_id").to_pylist(), texts_of(batch), strict=True) for m in match(normalized(body))]
                return batch_of(_OUT, *zip(*hits, strict=True)) if hits else None

            return step

        return arrow_map(picked, task, _KIND)

    out = [one(some) for some in passes(items, pass_chars, item_id, item_text)]
    return reduce(DataFrame.unionAll, out) if out else spark.createDataFrame([], _KIND)


def decontaminated(docs: DataFrame, items: DataFrame, share: float = ERROR_SHARE, pass_chars: int = PASS_CHARS, text: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that hold no item within its budget; null and blank texts stay.

    A filter over the rows themselves: null and repeated ids and clashing column names make no difference.
    """
    for some in passes(items, pass_chars):
        sent = docs.sparkSession.sparkContext.broadcast(some)

        @per_task
        def task(sent=sent):
            match = matcher(sent.value, share)

            def step(batch: pa.RecordBatch) -> pa.RecordBatch:
                return batch.filter(pa.array([not match(normalized(x)) for x in texts_of(batch, text)], pa.bool_()))

            return step

        docs = arrow_map(docs, task, docs.schema, column=text)
    return docs


def op5_edit_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
