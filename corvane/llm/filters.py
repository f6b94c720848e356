"""A filter of keys in a bit table of bounded size, to keep most rows from being dealt out before a join.

The table grows with the number of keys up to a bound.  A fuller table lets more rows pass; it never drops a row whose
key is wanted, and the join that follows drops the rest.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corvane.llm.workspace import unused

#: Bits of the table as powers of two: 4 KB at least, 32 MB at most.
BITS = (15, 28)


class KeyFilter:
    """hashed: the keys are evenly spread 64-bit numbers already, and their low bits are the place."""

    def __init__(self, keys: DataFrame, column: str, hashed: bool = False):
        self.hashed, count = hashed, keys.count()
        self.bits = min(max(BITS[0], (8 * count + 1).bit_length()), BITS[1])
        table = np.zeros((1 << self.bits) // 8, np.uint8)
        place = keys.select((self.place(column) + 1).alias("p"))
        rows = place.groupBy(F.bitmap_bucket_number(F.col("p")).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("p"))).alias("bits"))
        for r in rows.collect():  # at most 8192 rows of 4 KB; bucket k holds 32768 positions from 32768 (k - 1)
            at = (r["k"] - 1) * 4096
            table[at : at + 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)[: len(table) - at]
        self.table = keys.sparkSession.sparkContext.broadcast(table)

    def place(self, column: str):
        """The place of a key in the table, which test() takes."""
        return F.pmod(F.col(column) if self.hashed else F.xxhash64(F.lit("wanted"), F.col(column)), F.lit(1 << self.bits))

    def test(self):
        """A function, for use in tasks, from places (or hashed keys) to whether their bits are set."""
        table, last = self.table, np.int64((1 << self.bits) - 1)

        def wanted(place: np.ndarray) -> np.ndarray:
            place = place.view(np.int64) & last
            return ((table.value[place >> 3] >> (place & 7).astype(np.uint8)) & 1).astype(bool)

        return wanted

    def keep(self, df: DataFrame, column: str, wanted: bool = True) -> DataFrame:
        """Rows that may have a wanted key; with wanted=False the others, which surely have none."""
        test, names = self.test(), df.columns

        def run(batches):
            for batch in batches:
                yield pa.RecordBatch.from_arrays(batch.columns[:-1], names).filter(pa.array(test(np.asarray(batch.column(len(names)))) == wanted))

        return df.withColumn(*unused(df, "place"), self.place(column)).mapInArrow(run, df.schema)
