"""Log-template mining as a Spark job.

1. Mask and tokenise every line with native expressions, on the whole text.
2. Collapse equal token sequences (partial aggregation: a line repeated a
   billion times leaves each task once).
3. Sequences of the same length and leading tokens form a leaf.  Leaves are
   sorted within partitions and clustered in one streaming pass that holds only
   the clusters of the current leaf.
4. Line counts and first sights of the clusters are aggregated, and lines get
   their template by an equality join on the hash of their sequence.

A cluster depends on what came before, in the order of first sight; a template id is the
hash of the first sequence of its cluster.  Yet only a sequence that founds a cluster or
changes a template matters for what comes later.  A sequence that agrees with all fixed
tokens of a template stays so, because a template only loses fixed tokens and never its
last.  So a group with more than ``HEADS`` sequences is replayed in rounds: one task walks
the next ``HEADS`` open sequences, all others that a template already covers are settled in
parallel slices, and the rest goes into the next round.  At the end the settled ones look up,
again in slices, the oldest cluster whose template covered them when they came.  The result
is that of one walk over all sequences.

``exact=True`` replaces leaves by one search tree per token count: a token without a branch
of its own goes to the shared branch if there is one, and opens its own only if nothing
there is similar.  The walk then needs all clusters of a token count in one task.
"""

from __future__ import annotations

import functools
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from buildlens.functions.numbers import round_to
from buildlens.functions import logtext as L
from buildlens.functions import rules
from buildlens.sources.storage import materialize, spread

EMPTY = "empty"
WILD = "<*>"
#: Sequences of a group that one task walks in a round, and sequences of a parallel slice.
HEADS = 200_000
SLICE = 20_000
#: Largest dictionary that is sent to every task, in rows and in characters of its templates.
BROADCAST_ROWS = 200_000
BROADCAST_CHARS = 32_000_000
_DIGIT = re.compile(r"\d")


def masked_lines(builds: DataFrame, text: str = "raw_logs", key: str = "build_id") -> DataFrame:
    """``(key, line_no, raw, seq)`` per non-blank line; ``seq`` joins the tokens by a space."""
    rows = builds.select(key, F.posexplode(F.split(F.col(text), "\n", -1)).alias("line_no", "raw"))
    seq = F.array_join(L.tokenize(L.mask_line(F.col("raw"))), " ")
    # An array of one is unpacked because a filter on ``seq`` would else be moved below it and mask every line again.
    return rows.filter(F.rlike("raw", F.lit(f"[^{rules.WHITESPACE_CLASS}]"))).select(
        key, "line_no", "raw", F.explode(F.array(seq)).alias("seq"))


def sequences(lines: DataFrame, key: str = "build_id") -> DataFrame:
    """Distinct token sequences with hash, line count and first sight."""
    return lines.filter("seq <> ''").groupBy("seq").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct(F.col(key).alias("build"), F.col("line_no"))).alias("seen")) \
        .withColumn("sid", F.md5("seq"))


def _branch(token: Column) -> Column:
    return F.when(F.rlike(token, F.lit(r"\p{Nd}")), F.lit(WILD)).otherwise(token)


def with_beginnings(seqs: DataFrame, prefix: int = rules.TEMPLATE_PREFIX_TOKENS) -> DataFrame:
    """Add the token count ``_n`` and the branches ``_b0``, ``_b1``, .. of the leading tokens."""
    tokens = F.split("seq", " ")
    return seqs.withColumns({"_n": F.size(tokens), **{f"_b{i}": F.coalesce(_branch(F.get(tokens, F.lit(i))), F.lit("")) for i in range(prefix)}})


def with_leaves(seqs: DataFrame, prefix: int = rules.TEMPLATE_PREFIX_TOKENS,
                max_children: int | None = rules.TEMPLATE_MAX_CHILDREN) -> tuple[DataFrame, DataFrame]:
    """Add ``leaf``: token count and leading tokens; and ``(leaf, n)``, the sequences of every leaf.

    Tokens with digits share one branch.  Below each node only the first
    ``max_children`` branches (by first sight) stay apart, the others join the
    shared branch.  The limit is worked out on the distinct beginnings, level by level;
    only the branches of nodes that are too full are looked up, and sequences are met
    once, if there is such a node at all.  ``seqs`` come :func:`with_beginnings`.
    """
    keys = [f"_b{i}" for i in range(prefix)]
    plain = F.concat_ws(" ", F.col("_n").cast("string"), *keys)
    starts = materialize(seqs.groupBy("_n", *keys).agg(F.min("seen").alias("_first"), F.count(F.lit(1)).alias("n")), "beginnings")
    if max_children is None:
        return seqs.withColumn("leaf", plain).drop("_n", *keys), starts.select(plain.alias("leaf"), "n")
    nodes, crowded = starts.withColumn("leaf", F.col("_n").cast("string")), False
    for key in keys:
        branches = nodes.filter(F.col(key) != "").groupBy("leaf", F.col(key).alias("_b")).agg(F.min("_first").alias("_first"))
        order = Window.partitionBy("leaf").orderBy("_first", "_b")
        known = branches.withColumn("_k", F.row_number().over(order)).filter(F.col("_k") <= max_children + 1)
        crowd = known.filter(F.col("_k") == max_children + 1).select("leaf", F.lit(True).alias("_crowded"))
        kept = materialize(known.join(crowd, "leaf").filter(F.col("_k") <= max_children).select("leaf", F.col("_b").alias("_kept")), "branches")
        if kept.isEmpty():
            branch = F.col(key)
        else:
            crowded = True
            full = kept.select("leaf", F.lit(True).alias("_full")).distinct()
            nodes = nodes.join(full, "leaf", "left").join(kept.withColumnRenamed("leaf", "_leaf"), (F.col("leaf") == F.col("_leaf")) & (F.col(key) == F.col("_kept")), "left")
            branch = F.when(F.col("_full") & F.col("_kept").isNull() & (F.col(key) != ""), F.lit(WILD)).otherwise(F.col(key))
        nodes = nodes.withColumn("leaf", F.concat_ws(" ", "leaf", branch)).drop("_full", "_kept", "_leaf")
    if not crowded:
        return seqs.withColumn("leaf", plain).drop("_n", *keys), starts.select(plain.alias("leaf"), "n")
    nodes = materialize(nodes.select("_n", *keys, "leaf", "n"), "nodes")
    sizes = nodes.groupBy("leaf").agg(F.sum("n").alias("n"))
    return seqs.join(nodes.drop("n"), ["_n", *keys]).drop("_n", *keys), sizes


#: Clusters of a leaf from which on a sequence is compared only with those that share enough of its tokens.
INDEXED = 256


class _Leaf:
    """Clusters of one leaf in order of creation: template tokens as numbers, 0 for the wildcard.

    With more than ``INDEXED`` clusters, lists of the clusters that began with a token at a place tell how many
    tokens a sequence can share with each; only clusters that may pass the threshold are compared.  Clusters with
    wildcards have lists of their own, as they need fewer shared tokens.
    """

    def __init__(self, width: int, numbers: dict[str, int] | None = None):
        self.numbers = {WILD: 0} if numbers is None else numbers
        self.grid = np.zeros((16, width), dtype=np.int32)
        self.wilds = np.zeros(16, dtype=np.int32)
        self.lists: dict[int, array] | None = None
        self.wild_lists: dict[int, array] = {}
        self.wild = array("i")
        self.leaders: list[str] = []
        self.grown: set[int] = set()

    def row(self, tokens: list[str]) -> np.ndarray:
        return np.array([self.numbers.setdefault(t, len(self.numbers)) for t in tokens], dtype=np.int32)

    def similar(self, row: np.ndarray, threshold: float) -> int:
        """Most similar cluster above the threshold, the oldest of equals, or -1."""
        count = len(self.leaders)
        if not count:
            return -1
        grid, at = self.grid[:count], None
        if self.lists is not None and threshold >= 0:
            at = self._candidates(row, threshold)
            if not len(at):
                return -1
            grid = grid[at]
        fixed = (grid != 0) & (row != 0)
        likeness = ((grid == row) & fixed).sum(axis=1) / np.maximum(fixed.sum(axis=1), 1)
        best = int(likeness.argmax())
        if not likeness[best] > threshold:
            return -1
        return best if at is None else int(at[best])

    def _candidates(self, row: np.ndarray, threshold: float) -> np.ndarray:
        """Clusters, oldest first, whose likeness can be above the threshold.

        A list may still name a cluster that has lost the token, so its counts are upper bounds.  A cluster
        without wildcards shares at least ``need`` tokens: it is named at least twice outside the ``need - 2``
        longest lists, which are not read.  Of the fixed tokens of the sequence at most the cluster's
        wildcards do not count, so the others are judged by all their lists.
        """
        keys = [place << 32 | token for place, token in enumerate(row.tolist()) if token]
        fixed, at = max(len(keys), 1), np.zeros(0, dtype=np.int64)
        need = int(threshold * fixed)
        while need and need / fixed > threshold:
            need -= 1
        while not need / fixed > threshold:
            need += 1
        named = [k for key in keys if (k := self.lists.get(key)) is not None]
        if len(named) >= need:
            named.sort(key=len)
            least = min(need, 2)
            merged = np.sort(np.concatenate([np.frombuffer(k, dtype=np.int32) for k in named[:len(named) - need + least]]))
            often = merged[least - 1:][merged[least - 1:] == merged[:len(merged) - least + 1]]
            at = often[np.flatnonzero(np.diff(often, prepend=-1))].astype(np.int64)
        if not self.wild:
            return at
        known = [np.frombuffer(k, dtype=np.int32) for key in keys if (k := self.wild_lists.get(key)) is not None]
        if not known:
            return at
        wild = np.array(self.wild)
        shared = np.bincount(np.concatenate(known), minlength=len(wild))
        open_ = wild[shared / np.maximum(len(keys) - self.wilds[wild], 1) > threshold]
        return np.union1d(at, open_) if len(open_) else at

    def _list(self, at: int) -> None:
        lists, name = self.lists, at
        if self.wilds[at]:
            lists, name = self.wild_lists, len(self.wild)
            self.wild.append(at)
        for place, token in enumerate(self.grid[at].tolist()):
            if token:
                lists.setdefault(place << 32 | token, array("i")).append(name)

    def join(self, at: int, row: np.ndarray) -> bool:
        """Whether the sequence changed the cluster's template."""
        if (self.grid[at] == row).all():
            return False
        merged = np.where(self.grid[at] == row, row, 0)
        changed, before = bool((merged != self.grid[at]).any()), self.wilds[at]
        self.grid[at] = merged
        self.wilds[at] = (merged == 0).sum()
        if changed:
            self.grown.add(at)
            if self.lists is not None and not before:
                self._list(at)
        return changed

    def found(self, sid: str, row: np.ndarray) -> int:
        count = len(self.leaders)
        if count == len(self.grid):
            self.grid = np.concatenate([self.grid, np.zeros_like(self.grid)])
            self.wilds = np.concatenate([self.wilds, np.zeros_like(self.wilds)])
        self.grid[count], self.wilds[count] = row, (row == 0).sum()
        self.leaders.append(sid)
        if self.lists is not None:
            self._list(count)
        elif count >= INDEXED:
            self.lists = {}
            for at in range(count + 1):
                self._list(at)
        return count

    def settle(self, sid: str, tokens: list[str], threshold: float) -> int:
        """Number of the cluster that the next sequence founds or joins."""
        row = self.row(tokens)
        at = self.similar(row, threshold)
        if at < 0:
            return self.found(sid, row)
        self.join(at, row)
        return at

    def place(self, sid: str, tokens: list[str], threshold: float) -> str:
        return self.leaders[self.settle(sid, tokens, threshold)]

    def templates(self) -> pd.DataFrame:
        """Templates of the clusters that are no longer their first sequence."""
        words = list(self.numbers)
        rows = [(i, self.leaders[i], " ".join(words[t] for t in self.grid[i])) for i in sorted(self.grown)]
        return pd.DataFrame(rows, columns=["at", "lid", "template"])


class _Tree:
    """Search tree over the leading tokens of sequences of one length; depth 0 is a single leaf."""

    def __init__(self, width: int, depth: int, max_children: int | None):
        self.width, self.depth, self.limit = width, min(depth, width), max_children or float("inf")
        self.numbers: dict[str, int] = {WILD: 0}
        self.branches: dict[tuple, set] = {}
        self.leaves: dict[tuple, _Leaf] = {}

    def keys(self, tokens: list[str]) -> list[str]:
        return [WILD if _DIGIT.search(t) else t for t in tokens[:self.depth]]

    def path(self, keys: list[str], lasting: bool = False) -> tuple | None:
        """Leaf that a search reaches; with ``lasting`` only if no later branch can lead it elsewhere."""
        at: tuple = ()
        for key in keys:
            own = self.branches.get(at, ())
            if key not in own:
                if WILD not in own or (lasting and len(own) < self.limit):
                    return None
                key = WILD
            at += (key,)
        return at if at in self.leaves else None

    def open(self, path: tuple) -> _Leaf:
        """The leaf at a path, with the branches that lead there."""
        for i, key in enumerate(path):
            self.branches.setdefault(path[:i], set()).add(key)
        return self.leaves.setdefault(path, _Leaf(self.width, self.numbers))

    def new_path(self, keys: list[str]) -> tuple:
        """Where a new cluster goes: own branches while a node has room, else the shared one."""
        at: tuple = ()
        for key in keys:
            own = self.branches.get(at, set())
            at += (key if key in own or len(own) < self.limit else WILD,)
        return at

    def text(self, row: np.ndarray) -> str:
        if not hasattr(self, "words") or len(self.words) != len(self.numbers):
            self.words = list(self.numbers)
        return " ".join(self.words[t] for t in row)


REPLAYED = "leaf string, kind string, sid string, lid string, idx int, path string, template string, ord long"


def _restored(state: pd.DataFrame, width: int, depth: int, max_children: int | None) -> tuple[_Tree, list[tuple]]:
    """Tree of the clusters so far; per cluster, in order of creation, its leaf and place there."""
    tree, clusters = _Tree(width, depth, max_children), []
    for lid, path, template in state.sort_values("idx")[["lid", "path", "template"]].itertuples(index=False):
        leaf = tree.open(tuple(path.split(" ")) if path else ())
        clusters.append((leaf, leaf.found(lid, leaf.row(template.split(" ")))))
    return tree, clusters


def _walk(heads: pd.DataFrame, state: pd.DataFrame, threshold: float, depth: int, max_children: int | None) -> pd.DataFrame:
    """The next sequences of one group in order, from the clusters so far.

    Rows: ``member`` (sid of cluster lid), ``version`` (a template and the order number from which
    it holds) and ``cluster`` (all clusters as they are now).
    """
    heads = heads.sort_values("ord")
    group = heads["leaf"].iat[0]
    tree, clusters = _restored(state, len(heads["seq"].iat[0].split(" ")), depth, max_children)
    paths = state.sort_values("idx")["path"].tolist()
    number = {(id(leaf), at): i for i, (leaf, at) in enumerate(clusters)}
    out = []
    for sid, seq, order in heads[["sid", "seq", "ord"]].itertuples(index=False):
        tokens = seq.split(" ")
        keys = tree.keys(tokens)
        path = tree.path(keys)
        leaf = tree.leaves[path] if path is not None else None
        row = (leaf or _Leaf(tree.width, tree.numbers)).row(tokens)
        at = leaf.similar(row, threshold) if leaf else -1
        if at < 0:
            path = tree.new_path(keys)
            leaf = tree.open(path)
            at = leaf.found(sid, row)
            number[id(leaf), at] = len(clusters)
            clusters.append((leaf, at))
            paths.append(" ".join(path))
            out.append((group, "version", None, sid, len(clusters) - 1, paths[-1], seq, order))
        elif leaf.join(at, row):
            i = number[id(leaf), at]
            out.append((group, "version", None, leaf.leaders[at], i, paths[i], tree.text(leaf.grid[at]), order))
        out.append((group, "member", sid, leaf.leaders[at], None, None, None, order))
    out += [(group, "cluster", None, leaf.leaders[at], i, paths[i], tree.text(leaf.grid[at]), None) for i, (leaf, at) in enumerate(clusters)]
    kinds = [object, object, object, object, "Int32", object, object, "Int64"]
    return pd.DataFrame({c.split(" ")[0]: pd.Series([r[i] for r in out], dtype=kinds[i]) for i, c in enumerate(REPLAYED.split(", "))})


def _covered(rows: pd.DataFrame, versions: pd.DataFrame, depth: int, max_children: int | None) -> pd.Series:
    """For each sequence the cluster that covers it: the first by number among those with a template all of whose
    fixed tokens agree, of the leaf that the sequence reaches for good; NULL where there is none.

    ``versions`` holds templates with the order number from which each holds (none: always).
    """
    width = len(rows["seq"].iat[0].split(" "))
    tree, by_path = _Tree(width, depth, max_children), {}
    for path, idx, lid, template, since in versions.sort_values("idx")[["path", "idx", "lid", "template", "ord"]].itertuples(index=False):
        key = tuple(path.split(" ")) if path else ()
        tree.open(key)
        by_path.setdefault(key, [])
        # Without a wildcard a template covers only the sequence that founded it, and that one was walked.
        if WILD in template.split(" "):
            by_path[key].append((idx, lid, [tree.numbers.setdefault(t, len(tree.numbers)) for t in template.split(" ")], -1 if pd.isna(since) else since))
    tokens = [s.split(" ") for s in rows["seq"]]
    paths = [tree.path(tree.keys(t), lasting=True) for t in tokens]
    out: list[str | None] = [None] * len(rows)
    orders = rows["ord"].to_numpy()
    for path in set(paths) - {None}:
        at = np.array([i for i, p in enumerate(paths) if p == path])
        grid = np.array([[tree.numbers.get(t, -1) for t in tokens[i]] for i in at], dtype=np.int32)
        open_ = np.ones(len(at), dtype=bool)
        for _, lid, template, since in by_path[path]:
            if not open_.any():
                break
            template = np.array(template)
            fixed = template != 0
            hit = open_ & (grid[:, fixed] == template[fixed]).all(axis=1) & (since <= orders[at]) & fixed.any()
            for i in at[hit]:
                out[i] = lid
            open_ &= ~hit
    return pd.Series(out, index=rows.index, dtype=object)


def _slices(rows: DataFrame, versions: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """Rows dealt into slices of about ``size`` of their group, and the versions for every slice."""
    counts = rows.groupBy("leaf").agg(F.ceil(F.count("*") / size).cast("int").alias("slices"))
    dealt = rows.join(counts, "leaf").withColumn("slice", F.pmod(F.xxhash64("sid"), F.col("slices")).cast("int")).drop("slices")
    each = versions.join(counts, "leaf").withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).drop("slices")
    return dealt, each.withColumnsRenamed({"leaf": "of_leaf", "slice": "of_slice"})


def _replay(seqs: DataFrame, threshold: float, heads: int, depth: int, max_children: int | None) -> DataFrame:
    """``(sid, lid, template)`` as ``_cluster``, of groups of any size: rounds of one walk and parallel slices."""
    spark = seqs.sparkSession
    keys = ["leaf", "seen", "sid"]
    every = materialize(seqs.select("leaf", "seen", "sid", "seq").repartitionByRange(*keys).sortWithinPartitions(*keys)
                        .select("leaf", "sid", "seq", F.monotonically_increasing_id().alias("ord")), "replay")
    ahead = Window.partitionBy("leaf").orderBy("ord")
    rest, state, walks = every, spark.createDataFrame([], REPLAYED), []

    def walk(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return _walk(a, b, threshold, depth, max_children) if len(a) else pd.DataFrame()

    def unsettled(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return a[_covered(a, b, depth, max_children).isna()][["leaf", "sid", "seq", "ord"]] if len(a) else pd.DataFrame()

    def settled(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"sid": a["sid"], "lid": _covered(a, b, depth, max_children)}) if len(a) else pd.DataFrame()

    while True:
        now = rest.withColumn("_r", F.row_number().over(ahead)).filter(F.col("_r") <= heads).drop("_r")
        done = now.groupBy("leaf").cogroup(state.withColumnRenamed("leaf", "of_leaf").groupBy("of_leaf")).applyInPandas(walk, REPLAYED)
        walks.append(materialize(done, "replay-walk"))
        state = walks[-1].filter("kind = 'cluster'")
        last = walks[-1].filter("kind = 'member'").groupBy("leaf").agg(F.max("ord").alias("_last"))
        left, clusters = _slices(rest.join(last, "leaf").filter(F.col("ord") > F.col("_last")).drop("_last"), state, SLICE)
        rest = left.groupBy("leaf", "slice").cogroup(clusters.groupBy("of_leaf", "of_slice")).applyInPandas(unsettled, "leaf string, sid string, seq string, ord long")
        rest = materialize(rest, "replay-rest")
        if rest.isEmpty():
            break
    walked = functools.reduce(DataFrame.unionByName, walks)
    members, versions = walked.filter("kind = 'member'").select("sid", "lid"), walked.filter("kind = 'version'")
    quiet, each = _slices(every.join(members, "sid", "left_anti"), versions, SLICE)
    found = quiet.groupBy("leaf", "slice").cogroup(each.groupBy("of_leaf", "of_slice")).applyInPandas(settled, "sid string, lid string")
    final = versions.groupBy("lid").agg(F.max_by("template", "ord").alias("template"), F.count("*").alias("n")).filter("n > 1")
    assigned = members.unionByName(found).withColumn("template", F.lit(None).cast("string"))
    return assigned.unionByName(final.select(F.lit(None).cast("string").alias("sid"), "lid", "template"))


CLUSTERED = "sid string, lid string, template string, n long, build string, line_no int"
#: Rows that a task of the streaming pass gathers from small leaves before it hands them on.
GATHERED = 10_000


def _leaf_rows(rows: list[tuple], threshold: float) -> Iterator[tuple]:
    """Rows as ``CLUSTERED`` of one leaf, from ``(sid, seq, n, build, line_no)`` in order."""
    if len(rows) == 1:
        sid, seq, n, build, line_no = rows[0]
        return iter([(sid, sid, seq, n, build, line_no)])
    tokens = rows[0][1].split(" ")
    leaf = _Leaf(len(tokens))
    places = [leaf.settle(sid, seq.split(" "), threshold) for sid, seq, *_ in rows]
    sizes, heads = [0] * len(leaf.leaders), [-1] * len(leaf.leaders)
    for i, at in enumerate(places):
        sizes[at] += rows[i][2]
        if heads[at] < 0:
            heads[at] = i
    texts = [rows[i][1] for i in heads]
    if leaf.grown:
        for at, _, text in leaf.templates().itertuples(index=False):
            texts[at] = text
    return ((rows[i][0], leaf.leaders[at], texts[at], *((sizes[at], *rows[i][3:]) if heads[at] == i else (None, None, None)))
            for i, at in enumerate(places))


def _cluster(seqs: DataFrame, threshold: float) -> DataFrame:
    """A row per sequence with the hash of its cluster's first sequence and the template; the row of
    that first sequence also has the cluster's line count and first sight."""

    def frame(rows: list[tuple]) -> pd.DataFrame:
        kinds = [object, object, object, "Int64", object, "Int32"]
        return pd.DataFrame({c.split(" ")[0]: pd.Series(v, dtype=kind) for c, v, kind in zip(CLUSTERED.split(", "), zip(*rows), kinds)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, rows, done = None, [], []
        for pdf in batches:
            for place, *row in zip(*(pdf[c].tolist() for c in ("leaf", "sid", "seq", "n", "build", "line_no"))):
                if place != at:
                    if rows:
                        done.extend(_leaf_rows(rows, threshold))
                    at, rows = place, []
                    while len(done) >= GATHERED:
                        yield frame(done[:GATHERED])
                        del done[:GATHERED]
                rows.append(row)
        if rows:
            done.extend(_leaf_rows(rows, threshold))
        for i in range(0, len(done), GATHERED):
            yield frame(done[i:i + GATHERED])

    ordered = spread(seqs.select("leaf", "seen", "sid", "seq", "n"), "leaf").sortWithinPartitions("leaf", "seen", "sid") \
        .select("leaf", "sid", "seq", "n", F.col("seen.build").cast("string").alias("build"), F.col("seen.line_no").alias("line_no"))
    return ordered.mapInPandas(run, CLUSTERED)


def _replayed(seqs: DataFrame, threshold: float, heads: int, depth: int, max_children: int | None) -> DataFrame:
    """Rows as ``_cluster``, of groups of any size."""
    replay = materialize(_replay(seqs, threshold, heads, depth, max_children), "replayed")
    members = replay.filter("sid IS NOT NULL").select("sid", "lid")
    sizes = members.join(seqs.select("sid", "n", "seen"), "sid").groupBy("lid").agg(F.sum("n").alias("n"), F.min("seen").alias("seen"))
    first = seqs.select(F.col("sid").alias("lid"), F.col("seq").alias("_head"))
    grown = replay.filter("sid IS NULL").select("lid", "template")
    clusters = sizes.join(first, "lid").join(grown, "lid", "left").withColumn("template", F.coalesce("template", "_head"))
    own = F.col("sid") == F.col("lid")
    return members.join(clusters, "lid").select(
        "sid", "lid", "template", F.when(own, F.col("n")).alias("n"), F.when(own, F.col("seen.build").cast("string")).alias("build"),
        F.when(own, F.col("seen.line_no")).alias("line_no"))


def _clustered(leaves: DataFrame, sizes: DataFrame, threshold: float, heads: int) -> DataFrame:
    """Leaves of up to ``heads`` sequences in one streaming pass, larger ones in rounds."""
    large = materialize(sizes.filter(F.col("n") > heads).select("leaf"), "large-leaves")
    if large.isEmpty():
        return _cluster(leaves, threshold)
    leaves = materialize(leaves, "leaves")
    small = _cluster(leaves.join(large, "leaf", "left_anti"), threshold)
    return small.unionByName(_replayed(leaves.join(large, "leaf", "left_semi"), threshold, heads, 0, None))


def mine_templates(lines: DataFrame, threshold: float = rules.TEMPLATE_SIMILARITY,
                   prefix: int = rules.TEMPLATE_PREFIX_TOKENS,
                   max_children: int | None = rules.TEMPLATE_MAX_CHILDREN,
                   exact: bool = False, heads: int = HEADS) -> tuple[DataFrame, DataFrame]:
    """``(templates, assignment)`` of masked lines.

    templates: ``template_id, template, tokens, n, seen`` with the line count ``n``.
    assignment: ``sid, template_id, template`` for every distinct sequence; a repeated
    sequence keeps the cluster that it joined first.  ``exact`` follows the search tree with
    its shared branches; ``heads`` bounds what one task walks at a time and changes no result.
    """
    if exact:
        seqs = materialize(sequences(lines), "sequences")
        leaves = seqs.withColumn("leaf", F.size(F.split("seq", " ")).cast("string"))
        clustered = materialize(_replayed(leaves, threshold, heads, prefix, max_children), "clusters")
    else:
        seqs = materialize(with_beginnings(sequences(lines), prefix), "sequences")
        clustered = materialize(_clustered(*with_leaves(seqs, prefix, max_children), threshold, heads), "clusters")
    assignment = clustered.select("sid", F.substring("lid", 1, 12).alias("template_id"), "template")
    build = seqs.schema["seen"].dataType["build"].dataType
    templates = clustered.filter("n IS NOT NULL").select(
        F.substring("lid", 1, 12).alias("template_id"), "template", F.split("template", " ").alias("tokens"), "n",
        F.struct(F.col("build").cast(build).alias("build"), "line_no").alias("seen"))
    return templates, assignment


def _small(table: DataFrame, rows: int = BROADCAST_ROWS, chars: int = BROADCAST_CHARS) -> bool:
    """Whether a table of texts is small enough to be sent to every task: its rows and characters are counted, not guessed."""
    n, total = table.agg(F.count(F.lit(1)), F.sum(F.length("template"))).first()
    return n <= rows and (total or 0) <= chars


def assign_templates(lines: DataFrame, assignment: DataFrame, measured: bool = True) -> DataFrame:
    """Every line with its template; lines without tokens are ``empty``.

    Lines that the mining has not seen (a stream reads ahead of the last mining
    run) stand for themselves.  A dictionary of measured small size goes to the lines,
    so that no line moves; a larger one is joined by the hash of the sequence.
    """
    known = F.broadcast(assignment) if measured and _small(assignment) else assignment
    joined = lines.withColumn("sid", F.md5("seq")).join(known, "sid", "left")
    own = F.substring("sid", 1, 12)
    blank = F.col("seq") == ""
    return joined.withColumn("template_id", F.when(blank, EMPTY).otherwise(F.coalesce("template_id", own))) \
        .withColumn("template", F.when(blank, "").otherwise(F.coalesce("template", "seq"))) \
        .withColumn("tokens", F.when(blank, F.array().cast("array<string>")).otherwise(F.split("seq", " "))) \
        .drop("seq", "sid")


def unmatched_sequences(lines: DataFrame, assignment: DataFrame) -> DataFrame:
    """``seq, n``: distinct sequences that a dictionary does not hold; they wait for the next mining run."""
    return lines.filter("seq <> ''").groupBy("seq").agg(F.count(F.lit(1)).alias("n")).withColumn("sid", F.md5("seq")) \
        .join(assignment.select("sid"), "sid", "left_anti").select("seq", "n")


DICTIONARY = "sid string, template_id string, template string, version int"


def save_dictionary(assignment: DataFrame, folder: str, version: int) -> None:
    """Store what a mining run found as one version; earlier versions stay for whoever reads them."""
    assignment.select("sid", "template_id", "template").write.mode("overwrite").parquet(f"{folder}/version={version}")


def latest_dictionary(spark: SparkSession, folder: str) -> DataFrame:
    """The newest version: ``sid, template_id, template``."""
    stored = spark.read.schema(DICTIONARY).parquet(folder)
    newest = stored.agg(F.max("version")).first()[0]
    return stored.filter(F.col("version") == newest).drop("version")


def mined_measures(lines: DataFrame, assignment: DataFrame, key: str = "build_id", digits: int = 4) -> DataFrame:
    """``unique_templates`` and ``template_entropy`` per build over mined templates.

    Only hashes and counts of a build's distinct sequences meet the dictionary, no text.
    Builds without a line with tokens have no row.
    """
    counts = lines.filter("seq <> ''").groupBy(key, F.md5("seq").alias("sid")).agg(F.count(F.lit(1)).alias("_c"))
    known = counts.join(assignment.select("sid", "template_id"), "sid", "left") \
        .withColumn("template_id", F.coalesce("template_id", F.substring("sid", 1, 12)))
    return mined_template_measures(known, key, digits, F.col("_c"))


def mined_template_measures(assigned: DataFrame, key: str = "build_id", digits: int = 4, weight: Column | None = None) -> DataFrame:
    """``unique_templates`` and ``template_entropy`` per build from assigned lines, or from rows that stand for ``weight`` lines."""
    counts = assigned.groupBy(key, "template_id").agg(F.sum(F.lit(1) if weight is None else weight).alias("c"))
    n = F.sum("c")
    entropy = F.log2(n) - F.sum(F.col("c") * F.log2("c")) / n
    return counts.groupBy(key).agg(
        F.count(F.lit(1)).alias("unique_templates"),
        F.when(F.count(F.lit(1)) <= 1, F.lit(0.0)).otherwise(round_to(entropy, digits)).alias("template_entropy"))


def template_distribution(assigned: DataFrame) -> DataFrame:
    return assigned.groupBy("template_id", "template").agg(F.count(F.lit(1)).alias("n"))


def recent_templates(templates: DataFrame, limit: int = 50) -> DataFrame:
    """The last discovered templates."""
    return templates.orderBy(F.desc("seen"), "template_id").limit(limit)


def simple_lines(builds: DataFrame, text: str = "raw_logs", key: str = "build_id") -> DataFrame:
    """Non-blank lines with their simple template and its id."""
    rows = builds.select(key, F.posexplode(F.split(L.simple_template(F.col(text)), "\n", -1)).alias("line_no", "_t"))
    return rows.select(key, "line_no", L.strip(F.col("_t")).alias("template")).filter("template <> ''") \
        .withColumn("template_id", F.substring(F.md5("template"), 1, 12))


def parsed_logs(assigned: DataFrame, key: str = "build_id") -> DataFrame:
    """``(raw_log_id, templates, event_ids)``: all templates each build showed, with counts.

    Lines are counted per build and template before anything is collected.
    """
    counts = assigned.groupBy(key, "template_id", "template").agg(
        F.count(F.lit(1)).alias("count"), F.min("line_no").alias("first_line"))
    entry = F.struct("first_line", "template_id", "template", "count")
    return counts.groupBy(key).agg(F.sort_array(F.collect_list(entry)).alias("_e")).select(
        F.col(key).alias("raw_log_id"),
        F.transform("_e", lambda e: F.struct(e["template_id"], e["template"], e["count"])).alias("templates"),
        F.transform("_e", lambda e: e["template_id"]).alias("event_ids"))
