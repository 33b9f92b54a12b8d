"""A large sparse symmetric matrix as tables, and its products with narrow blocks of vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.shared import materialised

#: Bytes of vectors of the words with most entries, which are sent to all tasks for each product.
HEAD = 64 << 20


class Stored:
    """A symmetric matrix of entries (a, b, x), stored so that its products shuffle few of them.

    Most entries are with one of the words that have most of them, the head: as many as vectors of so many numbers take HEAD bytes for, so their vectors are sent to all
    tasks. A word's entries with the head are one row of places and numbers and stay where they are. The others, with rare words, are met by joins."""

    def __init__(self, matrix: DataFrame, width: int):
        self.size = max(1, HEAD // (8 * width))
        self.words = materialised(matrix.groupBy("a").agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("a", "word"), "matrix-words")
        first = self.words.orderBy(F.desc("n"), "word").limit(self.size)
        # one task numbers the head, whose size is fixed
        self.head = materialised(first.select("word", (F.row_number().over(Window.orderBy(F.desc("n"), "word")) - 1).cast("int").alias("at")), "matrix-head")
        met = matrix.join(F.broadcast(self.head.withColumnRenamed("word", "b")), "b", "left")
        rows = met.where("at IS NOT NULL").groupBy("a").agg(F.collect_list(F.struct("at", "x")).alias("e"))
        rows = rows.select("a", F.col("e.at").alias("at"), F.col("e.x").alias("x"))
        self.rest = None
        if self.words.count() > self.size:
            self.rest = materialised(met.where("at IS NULL").select("a", "b", "x"), "matrix-rest")
            rows = rows.join(self.rest.select("a", F.lit(True).alias("more")).distinct(), "a", "left")
        self.rows = materialised(rows, "matrix-rows")

    def times(self, block: DataFrame, width: int) -> DataFrame:
        """(word, vec): the matrix times a block of rows (word, vec)."""
        known = block.join(F.broadcast(self.head), "word").select("at", "vec").toArrow()
        vectors = np.zeros((self.size if self.rest is not None else known.num_rows, width))
        if known.num_rows:
            vectors[known.column("at").to_numpy()] = np.asarray(known.column("vec").combine_chunks().flatten(), np.float64).reshape(-1, width)
        sent = block.sparkSession.sparkContext.broadcast(vectors)

        def run(batches):
            v = sent.value
            for batch in batches:
                begin = batch.column(1).offsets.to_numpy()
                begin, at, x = begin - begin[0], batch.column(1).flatten().to_numpy(), batch.column(2).flatten().to_numpy()
                out = np.empty((batch.num_rows, width))
                for r, (p, q) in enumerate(zip(begin[:-1], begin[1:])):
                    out[r] = x[p:q] @ v[at[p:q]]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1) * width, pa.int32()), pa.array(out.ravel()))], names=["word", "vec"])

        made = lambda rows: rows.select("a", "at", "x").mapInArrow(run, f"word {dict(self.rows.dtypes)['a']}, vec array<double>")
        if self.rest is None:
            return made(self.rows)
        each = lambda w: F.array(*(F.sum(F.col(w) * F.get("vec", F.lit(j))) for j in range(width))).alias("vec")
        far = self.rest.join(block.withColumnRenamed("word", "b"), "b").groupBy(F.col("a").alias("word")).agg(each("x"))
        # words that have entries with the head only are whole
        more = made(self.rows.where("more")).unionByName(far).withColumn("_one", F.lit(1.0)).groupBy("word").agg(each("_one"))
        return made(self.rows.where("more IS NULL")).unionByName(more)
