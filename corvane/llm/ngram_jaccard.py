"""Exact n-gram Jaccard self-join of documents by a token-group matrix.

Two documents link when 100 * |A n B| >= percent * |A u B| for their sets of distinct word n-grams.

1. *Sets.*  Documents with equal sets become one set, known by 64 bits of a 128-bit digest (the few different sets that
   share them get keys of their own), with its size and a parity sketch: one bit per two or so members, the parity of the members hashed to it.
2. *Order.*  Tokens (hashes of n-grams) are ordered by hash, but those found frequent in counts of prefixes go last.
   By the prefix principle, two sets that link share a token among the first n - ceil(percent n / 100) + 1 of each in any common
   order, and the more the nearer their sizes are.  The frequent ones are a broadcast
   table whose size is bounded: the count that makes a token frequent is raised until the table fits.  The
   order alone depends on it, never the result.
3. *Groups.*  The sets that share a prefix token are compared with one leader a token, at most a few leaders for similar
   sets, which groups similar sets in linear time; components of these links, by bands of sizes, are the groups.
4. *Matrix.*  Rows (token, group) hold the union of the prefix tokens of a group.  A set's overlap with a
   group's union bounds its overlap with each member; only groups that reach what sizes, prefixes, order and parities demand are opened, and
   only groups other than its own.  Opened members are checked by size, sketch, and the exact sets.

No step brings a group into one task: rows of a token meet in joins that Spark can split, minima are taken
before rows are dealt out, and copies were merged before.  Sets travel only for pairs that sketches leave.

Defined cases: null text or no words: empty set, its own component.  Fewer than n words: the whole sequence is the
one n-gram.  Rows that repeat a doc_id share its component by their text each; a null doc_id gets a null
component and links nothing.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from corvane.llm import words as W
from corvane.llm.filters import KeyFilter
from corvane.llm.graph import components
from corvane.llm.substring_dedup import with_row
from corvane.llm.workspace import Workspace, unused

U64 = W.U64
#: A token in this many prefixes is frequent; a count beyond which more frequent tokens only are told apart, 8 bytes each.
FREQUENT, MOST_FREQUENT_TOKENS = 64, 1 << 20
#: Columns of 256 parities of a set.
QUAD = ["q0", "q1", "q2", "q3"]
#: Bits that the orders of leaders flip.
LEADER_ORDERS = (0, 0x2A5A5A5A5A5A5A5A, 0x5555AAAA5555AAAA, 0x7FF00FF00FF00FF0)
#: Shared prefix tokens of a set and a group that are asked for, at most.
MOST_NEEDED = 8
#: Members of a group whose sketches one row holds.
BLOCK = 128
#: Sets of a group are told apart by bands of sizes, each so much above the last: a band's least size is what bounds need.
SIZE_BAND = 1.04


def least_overlap(n, percent: int):
    """The least overlap that a set of n members has with any set it links to."""
    return (percent * n + 99) // 100


def prefix_length(n: int, percent: int) -> int:
    """How many first tokens of a set of n hold a token of any set it links to."""
    return n - least_overlap(n, percent) + 1 if n else 0


def shingles(texts: pa.Array, n: int) -> Iterator[np.ndarray]:
    """For each text its distinct n-grams as ascending 64-bit hashes."""
    data, offsets = W.column(texts)
    for a, b in W.chunks(offsets):
        _, _, h, first = W.words(data, offsets[a : b + 1], W.FOLDED)
        grams = W.grams(h, n)
        for i, j in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if j - i >= n:
                own = np.sort(grams[i : j - n + 1])
                yield own[np.concatenate(([True], own[1:] != own[:-1]))]
            elif j > i:
                yield W.grams(h[i:j], int(j - i))
            else:
                yield h[:0]


def digest(tokens: np.ndarray) -> tuple[int, int]:
    d = xxhash.xxh3_128_intdigest(tokens.tobytes())
    return (d & (2**64 - 1)) - 2**63, (d >> 64) - 2**63


def sketch(tokens: np.ndarray) -> bytes:
    """Parities of the members by a power of two of bits, at least as many as members."""
    bits = 1 << max(6, int(len(tokens) - 1).bit_length())
    place = ((tokens * U64(0x9E3779B97F4A7C15)) >> U64(24)).astype(np.int64) & (bits - 1)
    return np.packbits((np.bincount(place, minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def parities(tokens: np.ndarray) -> list[int]:
    """256 parities of the members as four numbers, for joins to compare."""
    place = ((tokens * U64(0x9E3779B97F4A7C15)) >> U64(24)).astype(np.int64) & 255
    return np.packbits((np.bincount(place, minlength=256) & 1).astype(np.uint8), bitorder="little").view(np.int64).tolist()


def fold(a: np.ndarray, size: int) -> np.ndarray:
    while len(a) > size:
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    return a


def may_link(a: bytes, b: bytes, na: int, nb: int, percent: int) -> bool:
    """False only if the sketches prove too large a symmetric difference."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    size = min(len(x), len(y))
    apart = int(np.bitwise_count(fold(x, size) ^ fold(y, size)).sum())
    least = -(-percent * (na + nb) // (100 + percent))
    return apart <= na + nb - 2 * least


def _sets(n: int):
    def run(batches):
        for batch in batches:
            keys, his, sizes, sketches, quads = [], [], [], [], []
            for s in shingles(batch.column(2), n):
                lo, hi = digest(s)
                keys.append(lo), his.append(hi), sizes.append(len(s)), sketches.append(sketch(s) if len(s) else b""), quads.append(parities(s))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.int64()), pa.array(his, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sketches, pa.binary()), *(pa.array([q[i] for q in quads], pa.int64()) for i in range(4))], ["doc_id", "row", "set", "guard", "n", "sketch", *QUAD])

    return run


#: Keys of the sets whose first 64 bits another set has too.
Renamed = dict[tuple[int, int], int]


def _distinct_sets(batches, n: int, renamed: Renamed) -> Iterator[tuple[int, np.ndarray]]:
    """Sets of a task's documents, mostly without repeats (a bounded memory of those seen)."""
    seen: set[int] = set()
    for batch in batches:
        for s in shingles(batch.column(0), n):
            if not len(s):
                continue
            both = digest(s)
            key = renamed.get(both, both[0])
            if key in seen:
                continue
            if len(seen) >= 100_000:
                seen.clear()
            seen.add(key)
            yield key, s


def _late(s: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    if not len(frequent):
        return np.zeros(len(s), bool)
    return frequent[np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)] == s


def prefix(s: np.ndarray, frequent: np.ndarray, percent: int) -> np.ndarray:
    """The first tokens of a set, frequent ones last."""
    length, late = prefix_length(len(s), percent), _late(s, frequent)
    return np.concatenate((s[~late], s[late]))[:length] if late.any() else s[:length]


def _tokens_first(n: int, percent: int):
    """What is counted of a set: its prefix by hash; if that holds frequent tokens, as far again as the prefix will then reach at
    their density, and a quarter more; its prefix in the final order."""

    def reach(s: np.ndarray) -> int:
        return prefix_length(len(s), percent)

    def first(s: np.ndarray, _):
        return s[: reach(s)]

    def rest(s: np.ndarray, frequent: np.ndarray):
        n = reach(s)
        late = int(_late(s[:n], frequent).sum())
        stop = len(s) if late == n else int(1.25 * n * n / (n - late)) + 8 if late else 0
        return s[n:stop]

    def final(s: np.ndarray, frequent: np.ndarray):
        return prefix(s, frequent, percent)

    return {"first": first, "rest": rest, "final": final}


def _counted(n: int, percent: int, frequent, which: str, renamed: Renamed):
    """Tokens to be counted: those of _tokens_first."""

    def run(batches):
        late, choose, held, rows = frequent.value if frequent is not None else np.zeros(0, U64), _tokens_first(n, percent)[which], [], 0
        for _, s in _distinct_sets(batches, n, renamed):
            held.append(choose(s, late))
            rows += len(held[-1])
            if rows >= 100_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(held).view(np.int64))], ["token"])
                held, rows = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(held).view(np.int64))], ["token"])

    return run


def _prefixes(n: int, percent: int, frequent, several, renamed: Renamed):
    """Prefix tokens that pass the test, with their set, its number of tokens from this one on, and behind the prefix."""

    def run(batches):
        late, tokens, keys, behind, after, rows = frequent.value if frequent is not None else np.zeros(0, U64), [], [], [], [], 0

        def out():
            lengths = [len(t) for t in tokens]
            columns = [np.concatenate(tokens).view(np.int64), np.repeat(np.array(keys, np.int64), lengths), np.concatenate(after), np.repeat(np.array(behind, np.int32), lengths)]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["token", "set", "rest", "behind"])

        for key, s in _distinct_sets(batches, n, renamed):
            first = prefix(s, late, percent)
            at = np.flatnonzero(several(first))
            tokens.append(first[at])
            keys.append(key), behind.append(len(s) - len(first)), after.append((len(s) - at).astype(np.int32))
            rows += len(tokens[-1])
            if rows >= 100_000:
                yield out()
                tokens, keys, behind, after, rows = [], [], [], [], 0
        if rows:
            yield out()

    return run


def _arrays(n: int, wanted, renamed: Renamed):
    """Sets as bytes, of the documents whose place passes the test."""

    def some(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0)], ["text"]).filter(pa.array(wanted(np.asarray(batch.column(1)))))

    def run(batches):
        held, size = [], 0
        for key, s in _distinct_sets(some(batches), n, renamed):
            held.append((key, s.tobytes()))
            size += 8 * len(s)
            if size >= 1 << 22:
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in held], pa.int64()), pa.array([b for _, b in held], pa.binary())], ["set", "tokens"])
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in held], pa.int64()), pa.array([b for _, b in held], pa.binary())], ["set", "tokens"])

    return run


def _by_sketch(percent: int):
    def run(batches):
        for batch in batches:
            na, nb, a, b = (batch.column(i).to_pylist() for i in (2, 3, 4, 5))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array([may_link(x, y, p, q, percent) for x, y, p, q in zip(a, b, na, nb, strict=True)], pa.bool_()))

    return run


def _opened(percent: int):
    """Pairs of a set and the members of a block of a group that sizes and sketches don't rule out."""

    def run(batches):
        for batch in batches:
            one, two = [], []
            for a, na, sketch, members in zip(*(batch.column(i) for i in range(4)), strict=True):
                a, na, sketch = a.as_py(), na.as_py(), sketch.as_py()
                for m in members.as_py():
                    b, nb = m["set"], m["n"]
                    if 100 * min(na, nb) >= percent * max(na, nb) and may_link(sketch, m["sketch"], na, nb, percent):
                        one.append(min(a, b)), two.append(max(a, b))
            yield pa.RecordBatch.from_arrays([pa.array(one, pa.int64()), pa.array(two, pa.int64())], ["a", "b"])

    return run


def _exactly(percent: int):
    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                a, b = np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64)
                if len(a) > len(b):
                    a, b = b, a
                at = np.minimum(np.searchsorted(b, a), len(b) - 1)
                both = int((b[at] == a).sum())
                keep.append(100 * both >= percent * (len(a) + len(b) - both))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _close(na: str, nb: str, percent: int) -> Column:
    return F.expr(f"100 * least({na}, {nb}) >= {percent} * greatest({na}, {nb})")


class JaccardJoin:
    """The join of one table; its steps are methods, their tables are written to a workspace."""

    def __init__(self, documents: DataFrame, n: int = 5, percent: int = 80, frequent: int = FREQUENT):
        self.spark, self.n, self.percent, self.frequent = documents.sparkSession, n, percent, frequent
        self.documents = with_row(documents)
        self.space, self.renamed = Workspace(self.spark, "jaccard"), {}

    def sets(self) -> DataFrame:
        """doc_id, row (a hash of the text), set, guard, n, sketch of each row."""
        rows = self.space.keep(self.documents.mapInArrow(_sets(self.n), "doc_id long, row long, set long, guard long, n long, sketch binary, q0 long, q1 long, q2 long, q3 long").withColumn("lo", F.col("set")), "sets")
        while True:  # d different sets hold about d**2 / 2**65 pairs with one key: 68 among 5 * 10**10
            clash = rows.where("n > 0").groupBy("set").agg(F.min("guard").alias("least"), F.max("guard").alias("most")).where("least <> most").select("set")
            alike = rows.where("n > 0").join(clash, "set", "left_semi").select("set", "guard", "lo").distinct().collect()
            if not alike:
                return rows
            turn = len(self.renamed)
            new = [(r["lo"], r["guard"], xxhash.xxh3_64_intdigest(f"{r['lo']} {r['guard']} {turn}") - 2**63) for r in alike]
            self.renamed |= {(lo, guard): key for lo, guard, key in new}
            new = self.spark.createDataFrame(new, "lo long, guard long, key long")
            rows = rows.join(F.broadcast(new), ["lo", "guard"], "left").withColumn("set", F.coalesce("key", "set")).drop("key")
            rows = self.space.keep(rows, f"sets-{turn + 1}")

    def counted(self, frequent, which: str) -> DataFrame:
        """(token, c): in how many sets a token is counted, of those in several."""
        tokens = self.documents.select("text").mapInArrow(_counted(self.n, self.percent, frequent, which, self.renamed), "token long")
        return self.space.keep(tokens.groupBy("token").agg(F.count("*").alias("c")).where("c > 1"), f"counts-{which}")

    def frequent_tokens(self):
        """Frequent tokens as a broadcast of bounded size, or None: first those of prefixes by hash, then those that move up when
        the first ones go last."""
        known, frequent = np.zeros(0, U64), None
        for which in ("first", "rest"):
            counts, least = self.counted(frequent, which), self.frequent
            while counts.where(F.col("c") >= least).count() > MOST_FREQUENT_TOKENS // 2:
                least *= 2
            known = np.union1d(known, counts.where(F.col("c") >= least).select("token").toArrow().column(0).to_numpy().view(U64))
            if not len(known):
                return None
            frequent = self.spark.sparkContext.broadcast(known)
            self.space.drop(f"counts-{which}")
        return frequent

    def shared_rows(self) -> DataFrame:
        """(token, set, rest, behind, leader) of the prefix tokens that several sets have; most tokens have one and are left out before rows are dealt out.

        A token's leader is the least of its sets in one of a few orders, which the token picks.
        """
        frequent = self.frequent_tokens()
        test = KeyFilter(self.counted(frequent, "final"), "token", hashed=True).test()
        rows = self.documents.select("text").mapInArrow(_prefixes(self.n, self.percent, frequent, test, self.renamed), "token long, set long, rest int, behind int")
        rows = self.space.keep(rows.distinct(), "prefixes")
        order = F.element_at(F.array(*(F.lit(c) for c in LEADER_ORDERS)), (F.pmod("token", F.lit(len(LEADER_ORDERS))) + 1).cast("int"))
        lead = rows.groupBy("token").agg(F.min(F.col("set").bitwiseXOR(order)).alias("x"), F.min("set").alias("least"), F.max("set").alias("most")).where("least <> most")
        lead = lead.select("token", F.col("x").bitwiseXOR(order).alias("leader"))
        out = self.space.keep(rows.join(lead, "token"), "shared")
        self.space.drop("prefixes")
        return out

    def verified(self, pairs: DataFrame, each: DataFrame, name: str) -> DataFrame:
        """Those of the pairs (a, b) that link.  Pairs that sketches don't rule out are written before texts are read again."""
        one, two = (each.select(F.col("set").alias(k), F.col("n").alias(f"n{k}"), F.col("sketch").alias(f"s{k}")) for k in "ab")
        pairs = pairs.join(one, "a").join(two, "b").where(_close("na", "nb", self.percent)).select("a", "b", "na", "nb", "sa", "sb")
        pairs = self.space.keep(pairs.mapInArrow(_by_sketch(self.percent), "a long, b long"), f"{name}-pairs")
        wanted = self.space.keep(pairs.select(F.explode(F.array("a", "b")).alias("set")).distinct(), f"{name}-wanted")
        ids = self.space.keep(each.join(wanted, "set", "left_semi").select("doc_id"), f"{name}-ids")
        near = KeyFilter(ids, "doc_id")  # one document of each set; texts are not dealt out
        documents = self.documents.where("doc_id is not null").select("text", near.place("doc_id"))
        arrays = documents.mapInArrow(_arrays(self.n, near.test(), self.renamed), "set long, tokens binary").join(wanted, "set", "left_semi").dropDuplicates(["set"])
        arrays = self.space.keep(arrays, f"{name}-arrays")
        one, two = (arrays.select(F.col("set").alias(k), F.col("tokens").alias(f"t{k}")) for k in "ab")
        links = pairs.join(one, "a").join(two, "b").select("a", "b", "ta", "tb").mapInArrow(_exactly(self.percent), "a long, b long")
        links = self.space.keep(links, f"{name}-links")
        self.space.drop(f"{name}-arrays")
        return links

    def links(self) -> tuple[DataFrame, DataFrame]:
        """The sets, and links between keys of different sets that join all sets which any chain of links joins."""
        sets = self.sets()
        each = self.space.keep(sets.where("n > 0 and doc_id is not null").groupBy("set").agg(F.first("n").cast("int").alias("n"), F.first("sketch").alias("sketch"), F.min("doc_id").alias("doc_id"), *(F.first(q).alias(q) for q in QUAD)), "each")
        shared = self.shared_rows()
        stars = shared.where("set <> leader").select(F.col("leader").alias("a"), F.col("set").alias("b")).distinct()
        stars = self.verified(stars, each, "star")
        groups = components(stars, "a", "b", self.space, "group")
        rest = self.verified(self.opened(shared, each, groups), each, "open")
        return sets, stars.unionByName(rest)

    def opened(self, shared: DataFrame, each: DataFrame, groups: DataFrame) -> DataFrame:
        """Pairs (a, b) of sets of different groups that the token-group matrix doesn't rule out."""
        band = F.floor(F.log("n") / np.log(SIZE_BAND)).cast("int")
        known = each.select("set", "n", *QUAD).join(groups.withColumnRenamed("node", "set"), "set", "left").select("set", "n", F.coalesce("component", "set").alias("g"), band.alias("band"), *QUAD)
        rows = self.space.keep(shared.select("token", "set", "rest", "behind").join(known, "set"), "grouped")
        several = rows.groupBy("token").agg(F.min("g").alias("x"), F.max("g").alias("y")).where("x <> y").select("token")
        rows = self.space.keep(rows.join(several, "token", "left_semi"), "crossing")
        self.space.drop("grouped")
        matrix = rows.groupBy("token", F.col("g").alias("h"), F.col("band").alias("h_band")).agg(F.min("n").alias("least"), F.max("n").alias("most"), F.max("rest").alias("open"), F.max("behind").alias("most_behind"), F.count("*").alias("members"), *(F.min(q).alias(f"h_{q}") for q in QUAD))
        sizes = F.expr(f"100 * most >= {self.percent} * n and 100 * n >= {self.percent} * least")
        # Two linked sets share `both` tokens at least, and so `need` in their prefixes; the first of those have nearly as many behind them.
        both = f"int(ceil({self.percent} * (n + least) / {100 + self.percent}.0))"
        need = f"greatest(1, least({MOST_NEEDED}, {both} - greatest(behind, most_behind)))"
        # Where one member has the token, its parities may prove too large a difference.
        apart = " + ".join(f"bit_count({q} ^ h_{q})" for q in QUAD)
        near = f"members > 1 or {apart} <= n + most - 2 * {both}"
        bound = rows.join(matrix, "token").where("g <> h").where(sizes).where(F.expr(near))
        # The need of a set and a group is the least over all tokens they share, of those too that lie too late to count.
        early = F.count_if(F.expr(f"least(rest, open) >= {both} - {need} + 1"))
        bound = bound.groupBy("set", "n", "h", "h_band").agg(early.alias("overlap"), F.min(F.expr(need)).alias("need")).where("overlap >= need")
        bound = self.space.keep(bound.select(F.col("set").alias("a"), F.col("n").alias("na"), "h", "h_band"), "bound")
        members = rows.select("set", F.col("g").alias("h"), F.col("band").alias("h_band")).distinct()
        size = members.groupBy("h", "h_band").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
        members = members.join(size, ["h", "h_band"]).join(each.select("set", "n", "sketch"), "set")
        block = F.pmod(F.xxhash64("set"), F.col("blocks")).alias("block")
        blocks = members.groupBy("h", "h_band", block).agg(F.collect_list(F.struct("set", "n", "sketch")).alias("members"))
        opened = bound.join(each.select(F.col("set").alias("a"), "sketch"), "a").join(blocks, ["h", "h_band"]).select("a", "na", "sketch", "members")
        return opened.mapInArrow(_opened(self.percent), "a long, b long").distinct()


def jaccard_components(documents: DataFrame, n: int = 5, percent: int = 80, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, row (a hash of the text), n_shingles, set (a key that copies share), component_id of each row of documents (doc_id, text)."""
    join = JaccardJoin(documents, n, percent, frequent)
    sets, links = join.links()
    groups = components(links, "a", "b", join.space, "component").withColumnRenamed("node", "set")
    named = sets.where("n > 0 and doc_id is not null").groupBy("set").agg(F.min("doc_id").alias("least")).join(groups, "set", "left").withColumn("component", F.coalesce("component", "set"))
    named = join.space.keep(named, "named")
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = join.space.keep(named.join(least, "component").select("set", "component_id"), "components")
    rows = sets.select("doc_id", "row", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("set")).alias("set"))
    rows = rows.join(named, "set", "left").select("doc_id", "row", "n_shingles", "set", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
    rows = join.space.keep(rows, "rows")
    join.space.only("rows")
    return rows


def one_of_each(documents: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """documents, all columns, without the rows of a component but for one of its smallest doc_id.

    Documents without words and rows with a null id stay.  Only texts that may be dropped are dealt out.
    """
    rows = jaccard_components(documents, n, percent).where("n_shingles > 0 and doc_id is not null")
    space = Workspace(documents.sparkSession, "kept")
    chosen = space.keep(rows.where("doc_id = component_id").groupBy("component_id").agg(F.min("row").alias("chosen"), F.count("*").alias("copies")), "chosen")
    judged = rows.join(chosen, "component_id").select("doc_id", "row", F.expr("doc_id <> component_id or row <> chosen").alias("dropped"), "copies")
    judged = judged.where("dropped or copies > 1").groupBy("doc_id", "row").agg(F.max("dropped").alias("dropped")).withColumn("key", F.xxhash64("doc_id", "row"))
    judged = space.keep(judged, "judged")
    space.only("judged")
    some = KeyFilter(judged, "key")
    row, key, its_id, its_row = unused(documents, "row", "key", "its_id", "its_row")
    keyed = documents.withColumn(row, F.xxhash64(F.col("text").cast("string"))).withColumn(key, F.xxhash64(F.col("doc_id").cast("long"), row))
    touched = some.keep(keyed, key)
    on = [F.col("doc_id").cast("long") == F.col(its_id), F.col(row) == F.col(its_row)]
    dropped, repeated = (judged.where(c).select(F.col("doc_id").alias(its_id), F.col("row").alias(its_row)) for c in ("dropped", "not dropped"))
    touched = touched.join(dropped, on, "left_anti")
    once = touched.join(repeated, on, "left_semi").dropDuplicates(["doc_id", row])
    kept = some.keep(keyed, key, wanted=False).unionByName(touched.join(repeated, on, "left_anti")).unionByName(once)
    return kept.drop(row, key)
