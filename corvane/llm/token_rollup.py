"""Token totals by source, language and tokenizer version, maintained from signed deltas.

A change is a row (sign, source, lang, version, n_tokens): an insert is +1, a delete -1 with the old count, a revision both.  A batch
of changes is summed to one row a key and committed under its id: its sums are written aside, then one small file that names them is renamed into
place unless a file of that id is there, so a batch is there as a whole or not at all, and of two writers of one id one counts.  (The store's
rename has to refuse an existing file, as HDFS does; a local folder's does for one writer at a time.)  Totals are the sums over all commits.

Compaction sums exactly the commits that it saw, writes the sums aside with the names of the batches that they stand for, and is committed under the number
after the base that it saw.  Numbers stay taken, so of two compactions of one base one wins and the other is nothing; a batch that is
committed beside it isn't among its names and stays.  A reader or a compaction that finds files gone that another compaction replaced fails, and can be run again.

Batches are summed where they are read (sums are additive), so only keys are dealt out.  A lost executor costs tasks; a driver lost between
writing and renaming leaves a folder that is ignored.

Defined cases: null source or language is a key of its own; null text has no tokens and still is a document; keys whose documents all went are left out of totals; an
empty batch commits nothing but its id; repeated rows count each; extra columns are ignored.
"""

from __future__ import annotations

import base64
import uuid
from functools import cache
from hashlib import sha256

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, functions as F

from corvane.llm.workspace import small_batches
from corvane.session import shared_folder

TOKENIZERS = "/opt/tokenizers"
KEYS = ["source", "lang", "version"]
SCHEMA = "source string, lang string, version string, n_docs long, n_tokens long"
# Fixed value: the public pattern that splits text before byte-level merges.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@cache
def _encoding(ranks: bytes):
    import tiktoken

    pairs = (line.split() for line in ranks.splitlines() if line)
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in pairs}, special_tokens={})


def counted(documents: DataFrame, vocabulary: str = "byte_bpe_50k.tiktoken", folder: str = TOKENIZERS) -> DataFrame:
    """doc_id, source, lang, version, n_tokens of each row of documents, for words between blanks ("words-1") and for the vocabulary's byte-level merges."""
    spark = documents.sparkSession
    small_batches(spark)
    with open(f"{folder}/{vocabulary}", "rb") as f:
        ranks = spark.sparkContext.broadcast(f.read())  # a vocabulary's size doesn't depend on the data
    name = vocabulary.split(".")[0]

    def run(batches):
        encoding = _encoding(ranks.value)
        for batch in batches:
            texts = [t.as_py() or "" for t in batch.column(3)]
            words = [len(t.encode().split()) for t in texts]
            merges = [len(encoding.encode_ordinary(t)) for t in texts]
            n = len(texts)
            columns = [pa.chunked_array([c, c]).combine_chunks() for c in batch.columns[:3]]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(["words-1"] * n + [name] * n, pa.string()), pa.array(words + merges, pa.int64())], ["doc_id", "source", "lang", "version", "n_tokens"])

    texts = documents.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("lang").cast("string"), F.col("text").cast("string"))
    return texts.mapInArrow(run, "doc_id long, source string, lang string, version string, n_tokens long")


def inserts(counts: DataFrame) -> DataFrame:
    return counts.select(F.lit(1).alias("sign"), *KEYS, "n_tokens")


def deletes(counts: DataFrame) -> DataFrame:
    return counts.select(F.lit(-1).alias("sign"), *KEYS, "n_tokens")


def revisions(old: DataFrame, new: DataFrame) -> DataFrame:
    return deletes(old).unionByName(inserts(new))


class TokenRollup:
    """Totals in a folder that driver and executors share: sums below data/, for each batch a file of commits/ that names its sums, for
    each compaction a numbered file of bases/ that does, and below stands-for/ the names of the batches that a base replaced."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or f"{shared_folder(spark)}/corvane/rollup-{uuid.uuid4().hex}"
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(conf)
        for folder in ("commits", "bases"):
            self._fs.mkdirs(self._path(f"{self.path}/{folder}"))
        self._names_of = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), conf)
        rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        self._unless_there = spark.sparkContext._gateway.new_array(rename, 1)
        self._unless_there[0] = rename.NONE

    def _read(self, folder: str) -> dict[str, str]:
        if not self._fs.listStatus(self._path(f"{self.path}/{folder}")):
            return {}
        rows = self.spark.read.text(f"{self.path}/{folder}", wholetext=True).select("value").collect()
        return dict(r["value"].split("\n") for r in rows)

    def _state(self) -> tuple[dict[str, str], dict[str, str]]:
        """Sums of each batch that has a commit, and of each base ever, by number; batches are read first, so a base read after them replaces at most some of these."""
        commits = self._read("commits")
        return commits, {n: data for n, data in sorted(self._read("bases").items(), key=lambda x: int(x[0]))}

    def _commits(self) -> dict[str, str]:
        """Sums of each batch that has a commit, and of the last base; compaction keeps them few."""
        commits, bases = self._state()
        return commits | ({f"base-{[*bases][-1]}": [*bases.values()][-1]} if bases else {})

    def _replaced(self, bases: dict[str, str]) -> DataFrame | None:
        """The batches that these bases stand for; what is there of a compaction that wasn't committed stands for nothing."""
        if not bases or not self._fs.exists(self._path(f"{self.path}/stands-for")):
            return None
        rows = self.spark.read.schema("batch string, of string").parquet(f"{self.path}/stands-for")
        return rows.where(F.col("of").isin([_own(data) for data in bases.values()])).select("batch")

    def _live(self, state: tuple[dict[str, str], dict[str, str]] | None = None) -> dict[str, str]:
        """Commits that no base stands for, and the last base; old ones may still be there where a compaction was cut short."""
        commits, bases = state or self._state()
        replaced = self._replaced(bases)
        gone = {r["batch"] for r in replaced.where(F.col("batch").isin([*commits])).collect()} if commits and replaced is not None else set()
        last = {f"base-{[*bases][-1]}": [*bases.values()][-1]} if bases else {}
        return {c: data for c, data in commits.items() if c not in gone} | last

    def committed(self, batch: str) -> bool:
        commits, bases = self._state()
        replaced = self._replaced(bases)
        return batch in commits or replaced is not None and replaced.where(F.col("batch") == batch).limit(1).count() > 0

    def _commit(self, name: str, sums: DataFrame, folder: str = "commits", unique: str | None = None) -> bool:
        """Write sums aside, then let the first writer of the name win: a file is renamed unless there is one of that name."""
        unique = unique or uuid.uuid4().hex
        data, aside = f"{self.path}/data/{unique}", self._path(f"{self.path}/aside-{unique}")
        sums.write.parquet(data)
        stream = self._fs.create(aside, False)
        stream.write(bytearray(f"{name}\n{data}".encode()))
        stream.close()
        try:
            self._names_of.rename(aside, self._path(f"{self.path}/{folder}/{sha256(name.encode()).hexdigest()}"), self._unless_there)
        except Py4JJavaError as error:
            if "FileAlreadyExists" not in error.java_exception.getClass().getName():
                raise
            self._fs.delete(aside, False)
            self._fs.delete(self._path(data), True)
            return False
        return True

    def apply(self, batch: str, changes: DataFrame) -> bool:
        """Commit a batch of changes; False if it was there already."""
        if self.committed(batch):
            return False
        n = F.col("sign").cast("long")
        return self._commit(batch, changes.groupBy(*KEYS).agg(F.sum(n).alias("n_docs"), F.sum(n * F.col("n_tokens")).alias("n_tokens")))

    def totals(self) -> DataFrame:
        return self._summed(self._live())

    def _summed(self, live: dict[str, str]) -> DataFrame:
        if not live:
            return self.spark.createDataFrame([], SCHEMA)
        rows = self.spark.read.schema(SCHEMA).parquet(*live.values())
        return rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).where("n_docs <> 0 or n_tokens <> 0")

    def compact(self) -> bool:
        """Put one base in the place of all commits there are now; their names stay known.  False if another compaction of these came first."""
        commits, bases = state = self._state()
        live, own = self._live(state), uuid.uuid4().hex
        names = self.spark.createDataFrame([(n,) for n in sorted(set(live) & set(commits))], "batch string")
        names.coalesce(1).write.parquet(f"{self.path}/stands-for/of={own}")
        number = int([*bases][-1]) + 1 if bases else 1
        if not self._commit(str(number), self._summed(live), "bases", own):
            self._fs.delete(self._path(f"{self.path}/stands-for/of={own}"), True)
            return False
        for name, data in commits.items():  # a compaction that is cut short here is still right: the base stands for all of these
            self._fs.delete(self._path(f"{self.path}/commits/{sha256(name.encode()).hexdigest()}"), False)
            self._fs.delete(self._path(data), True)
        for data in bases.values():  # their numbers stay taken
            self._fs.delete(self._path(data), True)
        return True


def _own(data: str) -> str:
    """The name that sums were written under."""
    return data.rsplit("/", 1)[1]
