"""Exact n-gram Jaccard self-join by signature trees, down to the components of its links.

1. Every text becomes the set of its shingles' hashes. Equal sets are one node, named by a digest,
   with a bitmap of its tokens.
2. Two linked sets share k tokens of their prefixes (the first n - ceil(t * n) + k tokens in one
   order for all sets, short shingles late and those that are common in the corpus last); k grows
   with n. A set that shares fewer with all others together has no link and is left out. A token
   that two sets or more have left sends them to the block of the smallest of them, so linked sets meet.
3. In each block a signature tree over the members' bitmaps is traversed against itself: members
   that can't be linked to any other by bitmaps and sizes are left out before their tokens are fetched.
4. A second tree, with the tokens at hand, is traversed the same way and its last pairs are checked
   exactly; links that join nothing new are not looked for.
   In both steps a block too large for one task is split by hash, and its leader goes to every part.
   Members that find nobody in their part (first step) or aren't connected to the leader there
   (second step) meet the other parts, tree against tree; other parts need none. In the second step
   bitmaps meet first, and only members that may have a partner there send their tokens.
5. Components of the links carry the smallest id to all documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import nothing_held, table, written
from .shingles import shingle_sets
from .signature_tree import Forest, Possible, bitmap

#: Cells that count shingles' documents, to put common shingles last. Any counts give right results.
CELLS = 1 << 22
#: Most sets, and most tokens, that a part of a block has on average.
PART_SETS = 512
PART_TOKENS = 1 << 20
#: Bits of the bitmap that tells which sets' tokens are wanted: 8 MB.
SIEVE = 1 << 26
#: Set digests that a task remembers, to send a set's prefix once.
REMEMBERED = 100_000
#: Linked sets share one token of their prefixes, and one more for each STEP tokens.
STEP = 25
#: Ways that rows of a common token are dealt before they are counted, and that nodes of one root are when the root moves.
SALTS = 64
ROOT_SALTS = 16
#: Rows of a slim table (ids and flags) up to which it is broadcast to the sets' tokens, so that these don't move: some 20 MB.
SLIM = 200_000
#: Times that sets with too few shared tokens are left out.
SIFTS = 1


def _digest(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def _short(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "big", signed=True)


def _h(sid: str):
    """_short() of a digest column."""
    return F.conv(F.substring(F.hex(sid), 1, 16), 16, -10).cast("long")


def _cells(tokens: np.ndarray) -> np.ndarray:
    return (tokens & np.uint64(CELLS - 1)).astype(np.int64)


def _record(columns: list, kinds: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=t) for c, t in zip(columns, kinds, strict=True)], names)


def sets_and_counts(docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """(id, mark, n, sid, map) of each document, and (cell, hits) of cells that stand out in a task; the other columns are null.

    mark is a hash of the text: with the id it tells rows apart.
    """
    text = F.col(text_col).cast("string")
    slim = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("mark"))
    names = ["id", "mark", "n", "sid", "map", "cell", "hits"]

    def run(batches):
        nothing_held()
        cells, kind = np.zeros(CELLS, dtype=np.int32), pa.int64()
        for batch in batches:
            kind = batch.column(0).type
            kinds = [kind, pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.int64()]
            n, sid, maps = [], [], []
            for s in shingle_sets(batch.column(1), words):
                cells[_cells(s)] += 1  # two of a text in one cell count once
                n.append(len(s))
                sid.append(_digest(s))
                maps.append(bitmap(s))
            yield _record([batch.column(0), batch.column(2), n, sid, maps, [None] * len(n), [None] * len(n)], kinds, names)
        # Cells far above what chance gives them: a shingle there is in many of the task's documents.
        mean = cells.sum(dtype=np.int64) / CELLS
        hot = np.flatnonzero(cells >= mean + 8 * mean**0.5 + 8)
        for at in range(0, len(hot), 10_000):
            own = hot[at : at + 10_000]
            none = [None] * len(own)
            yield _record([none, none, none, none, none, own, cells[own]], [kind, pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.int64()], names)

    return slim.mapInArrow(run, f"id {dict(slim.dtypes)['id']}, mark long, n long, sid binary, map binary, cell int, hits long")


def prefixes(docs: DataFrame, words: int, percent: int, common: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    """(token, h, common) for every token in the prefix of a set: h is the short form of the set's digest, common tells of tokens in a cell that stands out."""
    slim = docs.select(F.col(text_col).cast("string").alias("text"))
    sent = slim.sparkSession.sparkContext.broadcast(common)  # CELLS bytes

    def run(batches):
        nothing_held()
        rank = sent.value
        seen: set[bytes] = set()
        for batch in batches:
            tokens, short, often = [], [], []
            for s in shingle_sets(batch.column(0), words):
                if not len(s) or (d := _digest(s)) in seen:
                    continue
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen.add(d)
                first = len(s) - -(-percent * len(s) // 100) + 1 + len(s) // STEP
                levels = rank[_cells(s)]
                own = s[:first] if not levels[:first].any() else s[np.argsort(levels, kind="stable")[:first]]
                tokens.append(own.view(np.int64))
                often.append(rank[_cells(own)] > 0)
                short.append(np.full(len(own), _short(d), dtype=np.int64))
            if tokens:
                yield _record([np.concatenate(tokens), np.concatenate(short), np.concatenate(often)], [pa.int64(), pa.int64(), pa.bool_()], ["token", "h", "common"])

    return slim.mapInArrow(run, "token long, h long, common boolean")


def sieve(sids: DataFrame) -> np.ndarray:
    """A bitmap of SIEVE bits that has each digest's bit set. Its size is fixed: of more digests it tells less, never wrongly no."""
    place = F.col("h").bitwiseAND(F.lit(SIEVE - 1))
    words = sids.select(_h("sid").alias("h")).select(F.shiftright(place, 6).alias("word"), F.expr("shiftleft(1L, cast(h & 63 as int))").alias("bit"))
    found = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
    bits = np.zeros(SIEVE // 64, dtype=np.int64)
    bits[found["word"].to_numpy(dtype=np.int64)] = found["bits"].to_numpy(dtype=np.int64)
    return bits.view(np.uint64)


def tokens_of(docs: DataFrame, words: int, bits: np.ndarray, text_col: str) -> DataFrame:
    """(sid, tokens as bytes) of the texts whose digest the sieve lets through; a task sends a set once while it remembers it."""
    sent = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches):
        nothing_held()
        through, seen = sent.value, set()
        for batch in batches:
            held: list[tuple] = []
            size = 0
            for s in shingle_sets(batch.column(0), words):
                d = _digest(s)
                place = _short(d) & (SIEVE - 1)
                if d in seen or not len(s) or not int(through[place >> 6]) >> (place & 63) & 1:
                    continue
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen.add(d)
                held.append((d, s.tobytes()))
                size += s.nbytes
                if size > 4_000_000:
                    yield _record(list(zip(*held, strict=True)), [pa.binary()] * 2, ["sid", "tokens"])
                    held, size = [], 0
            if held:
                yield _record(list(zip(*held, strict=True)), [pa.binary()] * 2, ["sid", "tokens"])

    return docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "sid binary, tokens binary")


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Runs of rows that agree in their first `keys` columns, of batches sorted by them."""
    key, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:keys] != key:
                if rows:
                    yield key, rows
                key, rows = row[:keys], []
            rows.append(row[keys:])
    if rows:
        yield key, rows


def possible_members(parts: DataFrame, percent: int) -> DataFrame:
    """(leader, part, split, sid, alive) of each row: whether the member may be linked to another one of its part. parts: leader, part, split, sid, n, map."""

    def run(batches):
        nothing_held()
        for (leader, part), rows in _groups(batches, 2):
            alive = Possible([r[3] for r in rows], [r[2] for r in rows], percent).alive
            k = len(rows)
            yield _record([[leader] * k, [part] * k, [rows[0][0]] * k, [r[1] for r in rows], alive], [pa.int64(), pa.int32(), pa.bool_(), pa.binary(), pa.bool_()], ["leader", "part", "split", "sid", "alive"])

    ordered = parts.select("leader", "part", "split", "sid", "n", "map").repartition("leader", "part").sortWithinPartitions("leader", "part")
    return ordered.mapInArrow(run, "leader long, part int, split boolean, sid binary, alive boolean")


def possible_across(meetings: DataFrame, percent: int) -> DataFrame:
    """The (leader, part, bundle, loose, sid) of members that may be linked to one of the other side. meetings: these, n and map."""

    def run(batches):
        nothing_held()
        names, kinds = ["leader", "part", "bundle", "loose", "sid"], [pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary()]
        for key, rows in _groups(batches, 3):
            alive = Possible([r[3] for r in rows], [r[2] for r in rows], percent, [r[0] for r in rows]).alive
            found = [(*key, r[0], r[1]) for r, a in zip(rows, alive.tolist(), strict=True) if a]
            if found:
                yield _record(list(zip(*found, strict=True)), kinds, names)

    ordered = meetings.select("leader", "part", "bundle", "loose", "sid", "n", "map").repartition("leader", "part", "bundle").sortWithinPartitions("leader", "part", "bundle")
    return ordered.mapInArrow(run, "leader long, part int, bundle int, loose boolean, sid binary")


def _placed(sized: DataFrame) -> DataFrame:
    """leader, parts, part and sid of each member (leader, sid, h, n): blocks are dealt by hash into parts, the leader goes to all of its block's."""
    blocks = sized.groupBy("leader").agg(F.greatest(F.ceil(F.sum("n") / PART_TOKENS), F.ceil(F.count("*") / PART_SETS)).cast("int").alias("parts"))
    dealt = sized.join(blocks, "leader").withColumn("own", F.pmod(F.xxhash64("sid"), F.col("parts")).cast("int"))
    everywhere = F.when(F.col("h") == F.col("leader"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array("own"))
    return dealt.select("leader", "parts", "sid", F.explode(everywhere).alias("part"))


def _meetings(loose: DataFrame, placed: DataFrame) -> DataFrame:
    """(leader, part, bundle, loose, sid): the loose members (leader, sid, own part), in bundles, with each other part of their block."""
    bundles = loose.groupBy("leader").agg(F.ceil(F.count("*") / PART_SETS).cast("int").alias("bundles"))
    wide = placed.select("leader", "parts").distinct().join(bundles, "leader")
    free = loose.join(wide, "leader").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).where("part <> own")
    free = free.select("leader", "part", F.pmod(F.xxhash64("sid", F.lit(7)), F.col("bundles")).cast("int").alias("bundle"), F.lit(True).alias("loose"), "sid")
    held = placed.join(wide.select("leader", "bundles"), "leader").withColumn("bundle", F.explode(F.sequence(F.lit(0), F.col("bundles") - 1)))
    return free.union(held.select("leader", "part", "bundle", F.lit(False).alias("loose"), "sid"))


def within_parts(parts: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) found in each part of a block, and (leader, part, loose) for members not connected to their leader in a split block.

    parts: leader, part, split, sid, tokens, a part's rows together.
    """

    def run(batches):
        nothing_held()
        names, kinds = ["a", "b", "leader", "part"], [pa.binary(), pa.binary(), pa.int64(), pa.int32()]
        for (leader, part), rows in _groups(batches, 2):
            sid = [r[1] for r in rows]
            forest = Forest([np.frombuffer(r[2], dtype=np.uint64) for r in rows], percent)
            tree = forest.tree(list(range(len(rows))))
            out = [(sid[i], sid[j], None, None) for i, j in forest.traverse(tree, tree)]
            if rows[0][0]:
                heads = {forest.components.find(i) for i, d in enumerate(sid) if _short(d) == leader}
                out += [(sid[i], None, leader, part) for i in range(len(sid)) if forest.components.find(i) not in heads]
            if out:
                yield _record(list(zip(*out, strict=True)), kinds, names)

    ordered = parts.select("leader", "part", "split", "sid", "tokens").repartition("leader", "part").sortWithinPartitions("leader", "part")
    return ordered.mapInArrow(run, "a binary, b binary, leader long, part int")


def across_parts(meetings: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between the loose members and the part that they meet. meetings: leader, part, bundle, loose, sid, tokens."""

    def run(batches):
        nothing_held()
        for _, rows in _groups(batches, 3):
            sid = [r[1] for r in rows]
            forest = Forest([np.frombuffer(r[2], dtype=np.uint64) for r in rows], percent)
            loose = forest.tree([i for i, r in enumerate(rows) if r[0]])
            part = forest.tree([i for i, r in enumerate(rows) if not r[0]])
            out = [(sid[i], sid[j]) for i, j in forest.traverse(loose, part)]
            if out:
                yield _record(list(zip(*out, strict=True)), [pa.binary()] * 2, ["a", "b"])

    ordered = meetings.select("leader", "part", "bundle", "loose", "sid", "tokens").repartition("leader", "part", "bundle").sortWithinPartitions("leader", "part", "bundle")
    return ordered.mapInArrow(run, "a binary, b binary")


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of the links (a, b): root is the smallest node of its component.

    In each round a node takes the smallest label around it, its former root takes it too, and then
    every node takes its label's own label, until no label changes: a number of rounds that grows
    with the logarithm of the nodes. Each round is a written table in the shared folder. What a root
    becomes is looked up once for each root and dealt ROOT_SALTS ways to the nodes that have it.
    """
    both = written(links.select(F.col("a").alias("node"), F.col("b").alias("to")).union(links.select("b", "a")).distinct(), "links")
    labels = written(both.groupBy("node").agg(F.min(F.least("node", "to")).alias("root")), "labels")
    while True:
        seen = both.join(labels.select(F.col("node").alias("to"), "root"), "to").groupBy("node").agg(F.min("root").alias("seen"))
        step = labels.join(seen, "node")
        hooks = step.groupBy(F.col("root").alias("node")).agg(F.min("seen").alias("hook"))
        step = written(step.join(hooks, "node", "left").select("node", F.col("root").alias("old"), F.least("root", "seen", "hook").alias("root")), "steps")
        moved = step.select(F.col("node").alias("j_node"), F.col("root").alias("j_root")).where("j_node <> j_root")
        moved = step.select("root").distinct().join(moved, F.col("root") == F.col("j_node")).select("j_node", "j_root", F.explode(F.sequence(F.lit(0), F.lit(ROOT_SALTS - 1))).alias("j_salt"))
        salted = step.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(ROOT_SALTS)).cast("int"))
        step = written(salted.join(moved, (F.col("root") == F.col("j_node")) & (F.col("salt") == F.col("j_salt")), "left").select("node", "old", F.least("root", "j_root").alias("root")), "labels")
        labels = step.select("node", "root")
        if step.where(F.col("old") != F.col("root")).isEmpty():
            return labels


def _shared(rows: DataFrame) -> DataFrame:
    """(token, h, leader) for tokens of two sets or more; the leader is the token's smallest h."""
    led = rows.groupBy("token").agg(F.min("h").alias("leader"), F.max("h").alias("other")).where("leader < other").select("token", "leader")
    return rows.select("token", "h").join(led, "token")


def _sifted(rows: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """(token, h, leader) for the prefix tokens that two sets or more share, without sets that share too few to have a link.

    Rows move once: a token's rows stand together, a common token's in SALTS places, and what has no
    company goes. A link's smaller set has at least percent % of the larger one's size, and shares
    1 + size // STEP prefix tokens.
    """
    salt = F.when(F.col("common"), F.pmod("h", F.lit(SALTS))).otherwise(0)
    together = Window.partitionBy("token", "salt")
    met = rows.withColumn("salt", salt).withColumn("low", F.min("h").over(together)).withColumn("high", F.max("h").over(together))
    met = written(met.where("common or low < high").select("token", "h", "common", "low"), "met")
    left = met.where("not common").select("token", "h", F.col("low").alias("leader"), "common").unionByName(_shared(met.where("common")).withColumn("common", F.lit(True)))
    need = nodes.groupBy("h").agg((1 + F.floor(F.ceil(F.min("n") * percent / 100) / STEP)).alias("need"))
    for _ in range(SIFTS):
        enough = left.groupBy("h").agg(F.count("*").alias("have")).join(need, "h").where("have >= need").select("h")
        stay = left.select("token", "h", "common").join(enough, "h", "left_semi")
        alone = Window.partitionBy("token")
        met = stay.where("not common").withColumn("leader", F.min("h").over(alone)).withColumn("high", F.max("h").over(alone)).where("leader < high")
        left = met.select("token", "h", "leader", "common").unionByName(_shared(stay.where("common")).withColumn("common", F.lit(True)))
        left = written(left, "shared")
    return left


def _slim(rows: DataFrame, name: str) -> DataFrame:
    """rows, written, and marked for a broadcast where there are SLIM of them at most."""
    rows = written(rows, name)
    return F.broadcast(rows) if rows.count() <= SLIM else rows


def _unlike(members: DataFrame) -> DataFrame:
    """(leader, sid) of the blocks, one of each that has the same members."""
    marks = [F.bit_xor(F.xxhash64("sid", F.lit(k))).alias(f"mark{k}") for k in (1, 2)]
    first = members.groupBy("leader").agg(*marks, F.count("*").alias("k")).where("k > 1").groupBy("mark1", "mark2", "k").agg(F.min("leader").alias("leader"))
    return members.join(first.select("leader"), "leader", "left_semi")


def link_sets(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The documents' sets (id, mark, n, sid) and links (a, b) of set digests that connect all similar sets."""
    found = written(sets_and_counts(docs, words, id_col, text_col), "sets")
    sets = found.where(F.col("sid").isNotNull()).select("id", "mark", "n", "sid")
    # Fixed bound: a level for each of CELLS cells at most.
    levels = found.where(F.col("cell").isNotNull()).groupBy("cell").agg(F.sum("hits").alias("hits")).toPandas()
    common = np.zeros(CELLS, dtype=np.int8)
    common[levels["cell"].to_numpy(dtype=np.int64)] = np.log2(levels["hits"].to_numpy(dtype=float)).astype(np.int8) + 1
    nodes = found.where("n > 0").groupBy("sid").agg(F.first("n").alias("n"), F.first("map").alias("map")).withColumn("h", _h("sid"))
    members = written(_sifted(prefixes(docs, words, percent, common, id_col, text_col), nodes.select("h", "n"), percent).select("leader", "h").distinct(), "members")
    nodes = written(nodes.join(members.select("h").distinct(), "h", "left_semi"), "nodes")
    sized = members.join(nodes, "h").select("leader", "h", "sid", "n", "map")
    placed = written(_placed(sized), "placed")
    bodies = nodes.select(F.col("sid").alias("n_sid"), "n", "map")
    parts = placed.join(bodies, F.col("sid") == F.col("n_sid")).withColumn("split", F.col("parts") > 1)
    tried = written(possible_members(parts, percent), "tried")
    alive = tried.where("alive").select("leader", "sid")
    lone = tried.where(F.col("split") & ~F.col("alive") & (_h("sid") != F.col("leader"))).select("leader", "sid", F.col("part").alias("own"))
    if not lone.isEmpty():
        met = possible_across(_meetings(lone, placed).join(bodies, F.col("sid") == F.col("n_sid")), percent)
        alive = alive.unionByName(met.select("leader", "sid"))
    alive = written(_unlike(alive.distinct()), "alive")
    # Texts don't move: they are hashed again where they are, and the wanted sets' tokens are sent.
    # Several tasks may send the same set.
    tokens = tokens_of(docs, words, sieve(alive.select("sid").distinct()), text_col).dropDuplicates(["sid"])
    full = written(tokens.select(F.col("sid").alias("t_sid"), "tokens"), "tokens")
    placed = _slim(_placed(alive.join(nodes.select("sid", "n", "h"), "sid")), "placed")
    parts = placed.join(full, F.col("sid") == F.col("t_sid")).select("leader", "part", (F.col("parts") > 1).alias("split"), "sid", "tokens")
    first = written(within_parts(parts, percent), "links")
    links = first.where(F.col("b").isNotNull()).select("a", "b")
    loose = first.where(F.col("b").isNull()).select("leader", F.col("a").alias("sid"), F.col("part").alias("own"))
    if not loose.isEmpty():
        able = possible_across(_meetings(loose, placed).join(bodies, F.col("sid") == F.col("n_sid")), percent)
        links = links.union(written(across_parts(_slim(able, "able").join(full, F.col("sid") == F.col("t_sid")), percent), "links"))
    return sets, links


def jaccard_components(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles and component_id of every document, by links of 100 * shared >= percent * union.

    A text's set holds its distinct shingles of `words` words, A-Z lower-cased, white space of ASCII
    between words; with fewer words the whole sequence is one shingle. A text without words (or null)
    has no shingles and is a component of its own. component_id is the smallest id that links reach;
    null ids count only where a component has no other. A row out for each row in; rows that repeat
    an id stay apart unless their sets link. Other columns are not read.
    """
    joined = _with_roots(*link_sets(docs, words, percent, id_col, text_col))
    return joined.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("first.id")).otherwise(F.col("id")).alias("component_id"))


def _with_roots(sets: DataFrame, links: DataFrame) -> DataFrame:
    """sets with `first`, the first row (no_id, id, mark) of each one's component; null for sets without shingles, which meet nobody."""
    nodes = sets.where("n > 0").groupBy("sid").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "mark")).alias("own"))
    roots = components(links)
    named = nodes.join(roots.select(F.col("node").alias("sid"), "root"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    least = named.groupBy("root").agg(F.min("own").alias("first"))
    named = named.select("sid", "root").join(least, "root").select(F.col("sid").alias("c_sid"), "first")
    found = sets.where("n > 0").join(named, F.col("sid") == F.col("c_sid"), "left").drop("c_sid")
    return found.unionByName(sets.where("n = 0").withColumn("first", F.lit(None).cast(found.schema["first"].dataType)))


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (all columns) of each component: that of the smallest id, null ids last, then of the smallest hash of the text.

    Documents without shingles all stay, but of rows that agree in id and text one stays.
    """
    sets = _with_roots(*link_sets(docs, words, percent, id_col, text_col))
    first = F.col("n").eqNullSafe(0) | (F.col("id").eqNullSafe(F.col("first.id")) & F.col("mark").eqNullSafe(F.col("first.mark")))
    keep = written(sets.where(first).groupBy(F.col("id").alias("__id"), F.col("mark").alias("__mark")).agg(F.count("*").alias("__rows")), "keep")
    # The rows travel as one struct, so that no column of theirs meets one of the join.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("own_id"), F.xxhash64(F.col(text_col).cast("string")).alias("own_mark"))
    same = F.col("own_id").eqNullSafe(F.col("__id")) & (F.col("own_mark") == F.col("__mark"))
    kept = rows.join(keep.where("__rows = 1"), same, "left_semi")
    if not keep.where("__rows > 1").isEmpty():
        kept = kept.union(rows.join(keep.where("__rows > 1"), same, "left_semi").dropDuplicates(["own_id", "own_mark"]))
    return kept.select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), words=4, percent=85)


QUERIES = {"op5_jaccard_join": query}
SQL: dict[str, str] = {}
