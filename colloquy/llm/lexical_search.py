"""Ranked lexical search: each item's TOP best documents, by branch and bound over document FP-trees.

1. One pass over the texts leaves each document's length and its term counts, restricted to terms of the items (a table in the
   shared folder); document frequencies and totals are counted on that table over all documents.
2. Within a task, TREE_CELLS / terms documents at a time make a tree: their term vectors, most frequent term first, share paths as in an
   FP-tree. A branch holds the greatest count of each term and the least length norm m below it, which bound every score below
   it. Up to LEAF documents that share a path, or neighbours in this order, are one leaf.
3. For each item the tree is searched depth first, the better bound first; branches under the item's TOP-th score so far are cut, leaves that
   remain are scored exactly.
4. That score starts from a look at one document in FIRST_LOOK: the TOP-th best of a part is never above the TOP-th best of all,
   so the look cuts nothing that counts, and tasks send few rows beyond those that can still win.

All arithmetic is on whole numbers, but for the weight's logarithm, so scores are exact and don't depend on partitions. Equal scores rank by doc_id, a null one
last; rows that repeat a doc_id are documents of their own. Null or blank texts have no terms: they aren't counted and aren't found.
Of repeated item ids all texts count together, those without an id as one item. Items go to the tasks in blocks of BLOCK_TERMS distinct terms and
BLOCK_ITEMS items, each with passes of its own; an item of more terms is a block alone, and its trees hold fewer documents. Very long texts are whole
in one task's memory. Other columns stay behind, whatever their names. An empty table on either side gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, documents, keyed_text, written

TOP = 50
LEAF = 32
TREE_CELLS = 1 << 25
BLOCK_TERMS, BLOCK_ITEMS = 8192, 1000
FIRST_LOOK = 64
#: Stands for a null doc_id where documents are ordered.
NO_ID = np.iinfo(np.int64).max
#: Lower case for A-Z, a space for every other ASCII character that is neither letter nor digit.
PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256))


def terms(text: bytes | None) -> list[bytes]:
    return text.translate(PLAIN).split() if text else []


def saturated(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 20 * m)


def term_vectors(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, n (all terms, with repeats), and the terms of the vocabulary with their counts; documents without any term are left out."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = shared.value.get
        for b in batches:
            n, found = [], []
            for text in b.column(1).to_pylist():
                all_terms = terms(text)
                n.append(len(all_terms))
                counts = Counter(map(place, all_terms))
                counts.pop(None, None)
                found.append(counts)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array([list(c) for c in found], pa.list_(pa.int32())), pa.array([list(c.values()) for c in found], pa.list_(pa.int64()))], names=["doc_id", "n", "term", "tf"])

    return keyed_text(docs).mapInArrow(run, "doc_id long, n long, term array<int>, tf array<long>").where("n > 0")


class DocumentTree:
    """An FP-tree over some documents: rows are (doc_id, m), entries their (term, tf), terms numbered from the most frequent on."""

    def __init__(self, doc_id: np.ndarray, m: np.ndarray, row: np.ndarray, term: np.ndarray, tf: np.ndarray, weight: np.ndarray):
        by = np.lexsort((term, row))
        row, term, tf = row[by], term[by], tf[by]
        begin = np.searchsorted(row, np.arange(len(doc_id) + 1))
        keys = [term[a:b].astype(">u4").tobytes() for a, b in zip(begin[:-1], begin[1:], strict=True)]
        order = np.array(sorted((k for k in range(len(keys)) if keys[k]), key=keys.__getitem__), np.int64)
        self.paths = [np.frombuffer(keys[k], ">u4") for k in order.tolist()]
        self.doc_id, self.m = doc_id[order], m[order]
        sizes = np.diff(begin)[order]
        self.begin = np.concatenate([[0], np.cumsum(sizes)])
        at = np.repeat(begin[:-1][order] - self.begin[:-1], sizes) + np.arange(self.begin[-1])
        self.term, self.tf = term[at], tf[at]
        self.value = saturated(self.tf, np.repeat(self.m, sizes))
        self.span: list[tuple[int, int]] = []
        self.children: list[list[int]] = []
        if len(order):
            self._branch()
            self._bound(weight)

    def _shared(self, low: int, high: int) -> int:
        """Terms at the head of all paths low to high - 1: as they are sorted, of the first and the last."""
        a, b = self.paths[low], self.paths[high - 1]
        n = min(len(a), len(b))
        differ = np.flatnonzero(a[:n] != b[:n])
        return int(differ[0]) if len(differ) else n

    def _parts(self, low: int, high: int) -> list[tuple[int, int]]:
        depth = self._shared(low, high)
        step = np.array([int(p[depth]) if len(p) > depth else -1 for p in self.paths[low:high]])
        edges = [low, *(low + 1 + np.flatnonzero(np.diff(step))).tolist(), high]
        if len(edges) == 2:  # one and the same path
            edges = [*range(low, high, max(LEAF, (high - low + 1) // 2)), high]
        parts: list[tuple[int, int]] = []
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if parts and b - parts[-1][0] <= LEAF:
                parts[-1] = parts[-1][0], b
            else:
                parts.append((a, b))
        return parts

    def _branch(self) -> None:
        todo = [(0, len(self.paths), -1)]
        while todo:
            low, high, parent = todo.pop()
            node = len(self.span)
            self.span.append((low, high))
            self.children.append([])
            if parent >= 0:
                self.children[parent].append(node)
            if high - low > LEAF:
                todo.extend((a, b, node) for a, b in self._parts(low, high))

    def _bound(self, weight: np.ndarray) -> None:
        most = np.zeros((len(self.span), len(weight)), np.int64)
        least = np.zeros(len(self.span), np.int64)
        for node in range(len(self.span) - 1, -1, -1):  # parents have smaller numbers
            low, high = self.span[node]
            least[node] = self.m[low:high].min()
            if self.children[node]:
                for c in self.children[node]:
                    np.maximum(most[node], most[c], out=most[node])
            else:
                np.maximum.at(most[node], self.term[self.begin[low] : self.begin[high]], self.tf[self.begin[low] : self.begin[high]])
        self.gain = most
        for node in range(len(self.span)):
            has = np.flatnonzero(most[node])
            self.gain[node, has] = weight[has] * saturated(most[node, has], least[node])

    def search(self, item: np.ndarray, weight: np.ndarray, best: Best) -> None:
        """Offers `best` every document that can be among an item's best; item: its terms."""
        if not self.span:
            return
        bound = self.gain[:, item].sum(axis=1)
        own = np.zeros(len(weight), np.int64)
        own[item] = weight[item]
        todo = [0]
        while todo:
            node = todo.pop()
            if bound[node] < best.least:
                continue
            if self.children[node]:
                todo.extend(sorted(self.children[node], key=bound.__getitem__))
                continue
            low, high = self.span[node]
            a, b = self.begin[low], self.begin[high]
            best.offer(np.add.reduceat(own[self.term[a:b]] * self.value[a:b], self.begin[low:high] - a), self.doc_id[low:high])


class Best:
    """The TOP best documents of an item so far, of those with a score of `least` and more."""

    def __init__(self, least: int, top: int):
        self.least, self.top = max(1, least), top
        self.score, self.doc_id = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def offer(self, score: np.ndarray, doc_id: np.ndarray) -> None:
        good = score >= self.least
        if not good.any():
            return
        score, doc_id = np.concatenate([self.score, score[good]]), np.concatenate([self.doc_id, doc_id[good]])
        keep = np.lexsort((doc_id, -score))[: self.top]
        self.score, self.doc_id = score[keep], doc_id[keep]
        if len(keep) == self.top:
            self.least = max(self.least, int(self.score[-1]))


class Block:
    """Some items: their ids and their terms as places in a vocabulary of their own."""

    def __init__(self) -> None:
        self.vocabulary: dict[bytes, int] = {}
        self.ids: list = []
        self.items: list[np.ndarray] = []

    def takes(self, new: set[bytes]) -> bool:
        return not self.ids or (len(self.ids) < BLOCK_ITEMS and len(self.vocabulary) + len(new - self.vocabulary.keys()) <= BLOCK_TERMS)

    def add(self, item_id, found: set[bytes]) -> None:
        self.ids.append(item_id)
        self.items.append(np.array([self.vocabulary.setdefault(t, len(self.vocabulary)) for t in sorted(found)], np.int64))


def _best(vectors: DataFrame, items: Sequence[np.ndarray], least: Sequence[int], df: np.ndarray, n_docs: int, n_terms: int, top: int) -> DataFrame:
    """item (its number), doc_id and score: of each task the documents that can still be among an item's best."""
    order = np.argsort(-df, kind="stable")  # the most frequent term first
    place = np.empty(len(df), np.int64)
    place[order] = np.arange(len(df))
    weight = np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df[order] + 1))).astype(np.int64)
    shared = vectors.sparkSession.sparkContext.broadcast((place, weight, [place[i] for i in items], list(least)))
    rows_of_tree = max(LEAF, TREE_CELLS // max(1, len(df)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, weight, items, least = shared.value
        best = [Best(x, top) for x in least]

        def grow(held: list[pa.RecordBatch]) -> None:
            t = pa.Table.from_batches(held).combine_chunks()
            doc_id = t.column("doc_id").fill_null(NO_ID).to_numpy()
            m = 50 + 50 * t.column("n").to_numpy() * n_docs // n_terms
            lists = t.column("term").chunk(0)
            row = np.repeat(np.arange(len(t)), lists.value_lengths().to_numpy())
            tree = DocumentTree(doc_id, m, row, place[lists.flatten().to_numpy()], t.column("tf").chunk(0).flatten().to_numpy(), weight)
            for item, b in zip(items, best, strict=True):
                tree.search(item, weight, b)

        held, rows = [], 0
        for b in batches:
            for at in range(0, b.num_rows, rows_of_tree):
                held.append(part := b.slice(at, rows_of_tree))
                rows += part.num_rows
                if rows >= rows_of_tree:
                    grow(held)
                    held, rows = [], 0
        if rows:
            grow(held)
        for k, b in enumerate(best):
            if len(b.score):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b.score), k, np.int32)), pa.array(b.doc_id, mask=b.doc_id == NO_ID), pa.array(b.score)], names=["item", "doc_id", "score"])

    return vectors.select("doc_id", "n", "term", "tf").mapInArrow(run, "item int, doc_id long, score long")


def _ranked(found: DataFrame, top: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last()))
    return found.withColumn("rank", rank).where(F.col("rank") <= top)


def _searched(docs: DataFrame, block: Block, top: int) -> DataFrame | None:
    vectors = written(term_vectors(docs, block.vocabulary), "term-vectors")
    n_docs, n_terms = vectors.agg(F.count(F.lit(1)), F.sum("n")).first()
    if not n_docs:
        return None
    df = np.zeros(len(block.vocabulary), np.int64)
    for r in vectors.select(F.explode("term").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).toLocalIterator():  # at most BLOCK_TERMS rows, or one item's terms
        df[r["term"]] = r["df"]
    look = vectors.where(F.pmod(F.xxhash64("doc_id", "n", "term"), F.lit(FIRST_LOOK)) == 0)
    least = [0] * len(block.items)
    for r in _ranked(_best(look, block.items, least, df, n_docs, n_terms, top), top).where(F.col("rank") == top).toLocalIterator():  # a row an item at most
        least[r["item"]] = r["score"]
    return _ranked(_best(vectors, block.items, least, df, n_docs, n_terms, top), top)


def best_documents(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """item_id, rank, doc_id and score of each item's `top` best documents with a score above 0."""
    spark = docs.sparkSession
    bounded_batches(spark)
    kind = items.schema["item_id"].dataType
    names = T.StructType([T.StructField("item", T.IntegerType()), T.StructField("item_id", kind)])
    out = spark.createDataFrame([], T.StructType([T.StructField("item_id", kind), T.StructField("rank", T.IntegerType()), T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType())]))

    def flush(block: Block) -> None:
        nonlocal out
        if block.vocabulary and (found := _searched(docs, block, top)) is not None:
            ids = spark.createDataFrame(list(enumerate(block.ids)), names)  # at most BLOCK_ITEMS rows
            out = out.unionByName(found.join(F.broadcast(ids), "item").select("item_id", "rank", "doc_id", "score"))

    block, item_id, found = Block(), None, set()

    def close() -> None:
        nonlocal block
        if found:
            if not block.takes(found):
                flush(block)
                block = Block()
            block.add(item_id, found)

    rows = items.select("item_id", F.col("text").cast("string").cast("binary").alias("text")).where("text is not null").orderBy("item_id")
    for r in rows.toLocalIterator():
        if r["item_id"] != item_id:
            close()
            item_id, found = r["item_id"], set()
        found |= set(terms(bytes(r["text"])))
    close()
    flush(block)
    return out


#: The terms of a text as SQL says them.
_SQL_TERMS = r"unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))"

OP13_SQL = f"""with words as (select doc_id, {_SQL_TERMS} as term from documents),
lengths as (select doc_id, count(*) as n from words group by 1),
totals as (select count(*) as n_docs, sum(n)::bigint as n_terms from lengths),
wanted as (select distinct item_id, term from (select item_id, {_SQL_TERMS} as term from benchmark)),
counts as (select doc_id, term, count(*) as tf from words where term in (select term from wanted) group by 1, 2),
weights as (select term, cast(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) as bigint) as w from counts, totals group by term, n_docs),
scores as (select item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms))))::bigint as score
  from wanted join counts using (term) join weights using (term) join lengths using (doc_id), totals group by 1, 2),
ranked as (select item_id, row_number() over (partition by item_id order by score desc, doc_id)::int as rank, doc_id, score from scores where score > 0)
select item_id, rank, doc_id, score from ranked where rank <= {TOP}"""


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_documents(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
