"""Similarity join on word shingles: prefix filters under several global token orders, intersected, then verified.

Two sets link when ``den * |x & y| >= num * |x | y|``. A set that links with x misses at most ``n - ceil(t n)`` of the n tokens
of x, so each has one of its first ``n - ceil(t n) + 1`` tokens in common with the other, in any order of all tokens.

1. Equal sets become one row (:func:`_groups`).
2. A doc may miss few tokens only: of a fixed share of all tokens, those that no other set has are counted per set by
   sums alone. Sets with too many of them have no partner.
3. The rest is stored. Under several hash orders the sets that share their first token are read in runs, and each set is
   compared with the leaders of its run. Verified links merge sets into classes; runs are split by size.
4. What is left are links between different classes. They are looked for as in 5, but each cell names only the closest pairs of two classes,
   which are verified and merge more classes; ``ROUNDS`` times.
5. The last round is complete. Tokens that only one class has come first in every order: they bring no
   candidate. Sets whose prefix is made of such tokens are done. For the others, the tokens follow by rarity, in different ways for each order;
   sets that share a prefix token meet in a cell of bounded size, where sizes and parity bitmaps (an upper bound of the overlap)
   discard pairs. A pair must be found under every order; then its sets are compared.
6. Components of the links; each row gets the least doc_id.

No step drops a pair that links: all filters are necessary conditions. Nothing is collected but the number of links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.components import components
from tidegrid.llm.shingles import fingerprints, shingle_sets
from tidegrid.llm.store import byte_texts, frugal, list_column, mix, release, rows_per_batch, split_join, store

ORDERS = 3  # global token orders of the prefix filter
STARS = 3  # hash orders under which leaders are compared
LEADERS = 24  # of a run; only how soon links are found depends on it
RUN_ROWS = 5_000  # a larger run is split by the hash of the set
ROUNDS = 2  # that look for the closest pairs of classes before the complete one
CLOSEST = 1  # pairs of two classes that a cell names in such a round
CELL_ROWS = 2_048  # a larger posting list is split into pairs of blocks
SIGN_WORDS = 32  # 64-bit words of a parity bitmap
BATCH_ROWS = 1_000  # rows that hold sets or bitmaps and are in a kernel at once


def _prefix(n, num: int, den: int):
    """Tokens of a set of n that must be looked at; works on numbers, arrays and columns given as SQL text."""
    return n - (num * n + den - 1) // den + 1


def _prefix_sql(num: int, den: int) -> str:
    return f"(n - ({num} * n + {den - 1}) div {den} + 1)"


def _sets_of(docs: DataFrame, key: str, text: str, width: int, share: float) -> DataFrame:
    """(id, fp, n, h) of every row, h a hash of its text, or with ``share`` the tokens below that share of the hash range: (token, fp)."""
    top = np.uint64(min(int(share * 2.0**64), 2**64 - 1))

    @frugal
    def per_doc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat, sizes = shingle_sets(byte_texts(b.column(1)), width)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fingerprints(flat, sizes).view(np.int64)), pa.array(sizes), b.column(2)], ["id", "fp", "n", "h"])

    @frugal
    def per_token(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat, sizes = shingle_sets(byte_texts(b.column(0)), width)
            fp, keep = np.repeat(fingerprints(flat, sizes), sizes), flat <= top
            yield pa.RecordBatch.from_arrays([pa.array(flat[keep].view(np.int64)), pa.array(fp[keep].view(np.int64))], ["token", "fp"])

    if share:
        return docs.select(text).mapInArrow(per_token, "token long, fp long")
    return docs.select(F.col(key).cast("long").alias("id"), text, F.xxhash64(text).alias("h")).mapInArrow(per_doc, "id long, fp long, n long, h long")


def _full_sets(docs: DataFrame, width: int) -> DataFrame:
    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat, sizes = shingle_sets(byte_texts(b.column(0)), width)
            yield pa.RecordBatch.from_arrays(
                [pa.array(fingerprints(flat, sizes).view(np.int64)), pa.array(sizes), list_column(flat.view(np.int64), sizes, pa.int64())], ["fp", "n", "tokens"]
            )

    return docs.mapInArrow(run, "fp long, n long, tokens array<long>")


def _rows(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Flat values and offsets of a list column."""
    col = batch.column(name)
    return col.values.to_numpy(zero_copy_only=False), col.offsets.to_numpy()


def _first_tokens(sets: DataFrame) -> DataFrame:
    """(fp, g): the first token of each set under every hash order."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat, off = _rows(b, "tokens")
            fp, keys = b.column("fp").to_numpy(), []
            for k in range(STARS):
                h = mix(flat.view(np.uint64), 200 + k)
                keys.append(mix(np.minimum.reduceat(h, off[:-1]) if len(off) > 1 else h[:0], k).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.tile(fp, STARS)), pa.array(np.concatenate(keys))], ["fp", "g"])

    return sets.mapInArrow(run, "fp long, g long")


def _linked(a: frozenset, b: frozenset, num: int, den: int) -> bool:
    small, large = min(len(a), len(b)), max(len(a), len(b))
    if den * small < num * large:
        return False
    both = len(a & b)
    return den * both >= num * (len(a) + len(b) - both)


def _star_links(sets: DataFrame, num: int, den: int) -> DataFrame:
    """Verified links of sets with leaders of the runs they are in."""
    keyed = _first_tokens(sets)
    runs = keyed.groupBy("g").count().filter("count > 1")
    salted = split_join(keyed, runs, ["g"]).select("fp", F.xxhash64("g", F.expr(f"pmod(xxhash64(fp), (count + {RUN_ROWS - 1}) div {RUN_ROWS})")).alias("g"))
    rows = salted.join(sets, "fp").select("g", "fp", "n", "tokens")

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, leaders = None, []
        for b in batches:
            flat, off = _rows(b, "tokens")
            left, right = [], []
            for i, (g, fp) in enumerate(zip(b.column("g").to_pylist(), b.column("fp").to_pylist())):
                if g != group:
                    group, leaders = g, []
                mine = frozenset(flat[off[i] : off[i + 1]].tolist())
                hits = [x for x, other in leaders if x != fp and _linked(mine, other, num, den)]
                left += [fp] * len(hits)
                right += hits
                if not hits and len(leaders) < LEADERS:
                    leaders.append((fp, mine))
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    return rows.repartition("g").sortWithinPartitions("g", "fp").mapInArrow(run, "a long, b long")


def _postings(sets: DataFrame, num: int, den: int, orders: int) -> DataFrame:
    """(k, fp, prefix): prefix tokens under each of the first ``orders`` orders of the sets that may link with another class.

    ``sets`` has (fp, n, comp, tokens). A token's place in an order depends on the token alone.
    """
    tok = sets.select("fp", "comp", F.explode("tokens").alias("token"))
    cross = tok.groupBy("token").agg(F.count(F.lit(1)).alias("df"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("token", "df")
    own = split_join(tok.select("fp", "token"), cross, ["token"]).groupBy("fp").agg(F.collect_list("token").alias("tokens"), F.collect_list(F.col("df").cast("long")).alias("dfs"))
    live = own.join(sets.select("fp", "n"), "fp").filter(f"size(tokens) > n - {_prefix_sql(num, den)}")

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat, off = _rows(b, "tokens")
            df, doff = _rows(b, "dfs")
            out: tuple[list, list, list] = ([], [], [])
            for i, (fp, n) in enumerate(zip(b.column("fp").to_pylist(), b.column("n").to_pylist())):
                t, d = flat[off[i] : off[i + 1]], df[doff[i] : doff[i + 1]]
                most = _prefix(n, num, den) - (n - len(t))
                for k in range(orders):
                    rarity = d if k == 0 else np.floor(np.log2(d) * (2 if k == 1 else 1))
                    out[0].append(k)
                    out[1].append(fp)
                    out[2].append(t[np.lexsort((mix(t.view(np.uint64), 300 + k), rarity))[:most]])
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.list_(pa.int64()))], ["k", "fp", "prefix"])

    return live.select("fp", "n", "tokens", "dfs").mapInArrow(run, "k int, fp long, prefix array<long>")


def _signatures(sets: DataFrame) -> DataFrame:
    """(fp, comp, n, sign): bit i of ``sign`` is the parity of the tokens that fall on i."""
    bits = SIGN_WORDS * 64

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat, off = _rows(b, "tokens")
            place = (mix(flat.view(np.uint64), 400) % np.uint64(bits)).astype(np.int64)
            signs = [np.packbits((np.bincount(place[lo:hi], minlength=bits) & 1).astype(np.uint8)).tobytes() for lo, hi in zip(off[:-1], off[1:])]
            yield pa.RecordBatch.from_arrays([b.column("fp"), b.column("comp"), b.column("n"), pa.array(signs, pa.binary())], ["fp", "comp", "n", "sign"])

    return sets.select("fp", "comp", "n", "tokens").mapInArrow(run, "fp long, comp long, n long, sign binary")


def _candidates(sets: DataFrame, num: int, den: int, complete: bool) -> tuple[DataFrame, str]:
    """(a, b): pairs of different classes that share a prefix token under every order and pass sizes and bitmaps.

    If not ``complete``, only the closest pairs of two classes in each cell of the first order.
    """
    orders = ORDERS if complete else 1
    prefixes, path = store(_postings(sets, num, den, orders), "prefixes")
    posts = prefixes.select("k", F.explode("prefix").alias("token"), "fp")
    wide = posts.join(sets.select("fp", "comp"), "fp")
    lists = wide.groupBy("k", "token").agg(F.count(F.lit(1)).alias("c"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi")
    blocks = F.expr(f"(c + {CELL_ROWS - 1}) div {CELL_ROWS}")
    cells = (
        split_join(posts, lists, ["token", "k"])
        .select("k", "token", "fp", blocks.alias("nb"))
        .withColumn("own", F.expr("pmod(xxhash64(fp), nb)"))
        .withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1)))
        .select("k", "token", "fp", "own", F.xxhash64("k", "token", F.least("own", "with"), F.greatest("own", "with")).alias("cell"), (F.col("own") <= F.col("with")).alias("left"), (F.col("own") == F.col("with")).alias("same"))
    )
    rows = cells.join(_signatures(sets), "fp").select("cell", "k", "token", "left", "same", "fp", "comp", "n", "sign")
    # what comes before the token in the set's prefix: a pair is named where its first common token is
    rows = rows.join(prefixes, ["k", "fp"]).withColumn("before", F.expr("slice(prefix, 1, array_position(prefix, token) - 1)")).drop("prefix")

    def pairs_of(rows: list[tuple]) -> tuple[list, list]:
        rows.sort(key=lambda r: r[5])
        left, same = np.array([r[1] for r in rows]), rows[0][2]
        fp, comp, n = (np.array([r[i] for r in rows], np.int64) for i in (3, 4, 5))
        sign = np.frombuffer(b"".join(r[6] for r in rows), np.uint64).reshape(len(rows), SIGN_WORDS)
        own = comp.tolist()
        reach = np.searchsorted(n, den * n // num, "right")
        a, b = [], []
        near: dict[tuple[int, int], list[tuple[float, int, int]]] = {}
        for i in range(len(rows) - 1):
            if reach[i] <= i + 1:
                continue
            s = slice(i + 1, reach[i])
            keep = comp[s] != comp[i]
            if not same:
                keep &= left[s] != left[i]
            at = np.flatnonzero(keep) + i + 1
            if len(at):
                apart = np.bitwise_count(sign[at] ^ sign[i]).sum(1, dtype=np.int64)
                # |x ^ y| is at least `apart`: the overlap is at most half of what is left of both sizes
                total = n[at] + n[i]
                both = (total - apart) // 2
                close = den * both >= num * (total - both)
                mine = frozenset(rows[i][7])
                first = [j for j in np.flatnonzero(close).tolist() if mine.isdisjoint(rows[at[j]][7])]
                hit = at[first]
                if complete:
                    a += [int(fp[i])] * len(hit)
                    b += fp[hit].tolist()
                    continue
                for c, d, y in zip(comp[hit].tolist(), (apart[first] / total[first]).tolist(), fp[hit].tolist()):
                    best = near.setdefault((min(c, own[i]), max(c, own[i])), [])
                    if len(best) < CLOSEST or d < best[-1][0]:
                        best.append((d, int(fp[i]), y))
                        best.sort()
                        del best[CLOSEST:]
        for best in near.values():
            a += [x for _, x, _ in best]
            b += [y for _, _, y in best]
        return a, b

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, k = None, [], 0
        left: list = []
        right: list = []
        order: list = []

        def close() -> None:
            if len(held) > 1:
                a, b = pairs_of(held)
                left.extend(a)
                right.extend(b)
                order.extend([1 << k] * len(a))

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("cell", "left", "same", "fp", "comp", "n", "sign", "before", "token", "k"))):
                if (row[0], *row[8:]) != cell:
                    close()
                    cell, held, k = (row[0], *row[8:]), [], row[9]
                held.append(row)
            if len(left) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (left, right, order)], ["a", "b", "k"])
                left.clear(), right.clear(), order.clear()
        close()
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (left, right, order)], ["a", "b", "k"])

    found = rows.repartition("cell").sortWithinPartitions("cell", "token", "k").mapInArrow(run, "a long, b long, k long")
    pairs = found.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.bit_or("k").alias("k")).filter(f"k = {(1 << orders) - 1}")
    return pairs.select("a", "b"), path


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, xo = _rows(b, "x")
            y, yo = _rows(b, "y")
            hit = []
            for i in range(b.num_rows):
                p, q = x[xo[i] : xo[i + 1]], y[yo[i] : yo[i + 1]]
                both = len(p) + len(q) - len(np.unique(np.concatenate([p, q])))
                hit.append(den * both >= num * (len(p) + len(q) - both))
            keep = pa.array(hit, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("ca").filter(keep), b.column("cb").filter(keep)], ["a", "b"])

    x = sets.select(F.col("fp").alias("a"), F.col("comp").alias("ca"), F.col("tokens").alias("x"))
    y = sets.select(F.col("fp").alias("b"), F.col("comp").alias("cb"), F.col("tokens").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("ca", "cb", "x", "y").mapInArrow(run, "a long, b long")


def _merged(classed: DataFrame, links: DataFrame) -> DataFrame:
    """``classed`` after classes that ``links`` (node, root) join have become one."""
    found = classed.join(links, classed["comp"] == links["node"], "left")
    return found.withColumn("comp", F.coalesce("root", "comp")).drop("node", "root")


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """One row per row of ``docs``: the key, ``n_shingles`` and ``component_id``.

    ``component_id`` is the smallest key that links reach. Rows with equal sets link; rows without words (null text included) have
    no set and link with nothing. A row without key gets the component of rows with an equal set, else null. Repeated rows are returned as often as they are there;
    further columns are not looked at.
    """
    with rows_per_batch(docs.sparkSession, BATCH_ROWS):
        return _components_of_rows(docs, key, text, width, num, den).drop("h")


def _components_of_rows(docs: DataFrame, key: str, text: str, width: int, num: int, den: int) -> DataFrame:
    """As :func:`jaccard_components`, and ``h``, the hash of the row's text. All that kernels do is stored when it returns."""
    spark = docs.sparkSession
    docs = docs.select(F.col(key).cast("long").alias("__id"), F.col(text).alias("__text"))
    own, _ = store(_sets_of(docs, "__id", "__text", width, 0), "sizes")
    groups = own.filter("n > 0").groupBy("fp").agg(F.min("id").alias("least"), F.first("n").alias("n"))
    share = min(1.0, 1.6 * (den - num) / den)
    tokens = _sets_of(docs, "__id", "__text", width, share)
    alone = tokens.groupBy("token").agg(F.min("fp").alias("fp"), F.max("fp").alias("hi")).filter("fp = hi").groupBy("fp").agg(F.count(F.lit(1)).alias("missed"))
    alive = groups.join(alone, "fp", "left").filter(f"least is not null and coalesce(missed, 0) < {_prefix_sql(num, den)}")
    alive, alive_path = store(alive.select(F.col("least").alias("__id"), "n"), "alive")
    texts = docs.join(alive.filter("n > 0").select("__id"), "__id", "left_semi").select("__text")
    sets, sets_path = store(_full_sets(texts, width).filter("n > 0").dropDuplicates(["fp"]), "sets")

    links, links_path = components(_star_links(sets, num, den))
    classed, classed_path = store(_merged(sets.withColumn("comp", F.col("fp")), links), "classes")
    release(spark, sets_path, alive_path, links_path)
    for r in range(ROUNDS + 1):
        pairs, posts_path = _candidates(classed, num, den, complete=r == ROUNDS)
        pairs, pairs_path = store(pairs, "pairs")
        links, links_path = components(_verified(pairs, classed, num, den))
        merged = _merged(classed if r < ROUNDS else classed.select("fp", "comp"), links)
        old = classed_path
        classed, classed_path = store(merged, "classes")
        release(spark, old, links_path, pairs_path, posts_path)
    rooted = classed.select("fp", F.col("comp").alias("root"))

    held = groups.join(rooted, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = held.groupBy("root").agg(F.min("least").alias("component_id"))
    named = split_join(held, least, ["root"]).select("fp", "component_id")
    out = own.filter("n > 0").join(named, "fp").select("id", "n", "component_id", "h").union(own.filter("n = 0").select("id", "n", "id", "h"))
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), "component_id", "h")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of ``docs`` whose key is the least of its component, with all their columns; rows without key stay.

    Of texts that share a key, each belongs to its own component: a row goes by its key and its text.
    """
    with rows_per_batch(docs.sparkSession, BATCH_ROWS):
        found = _components_of_rows(docs, key, text, width, num, den)
        gone, _ = store(found.filter(f"`{key}` <> component_id").select(F.col(key).alias("__gone"), F.col("h").alias("__text_hash")).distinct(), "gone")
    same = (docs[key].cast("long") == gone["__gone"]) & (F.xxhash64(docs[text]) == gone["__text_hash"])
    return docs.join(gone, same, "left_anti")
