"""Components, near-duplicates, leaks, shards against plain versions."""

import collections
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tokenmill.llm import components, hash_tree, leaks, minmax

from .edge_rows import awkward, clashing, empty, prose, table
from .test_text_kernels import ascii_lower, words


def plain_components(pairs):
    parent = {}
    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x
    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    pick = random.Random(seed)
    pairs = [(pick.randint(0, 150), pick.randint(0, 150)) for _ in range(90)]
    pairs += [(1000 + i, 1001 + i) for i in range(40)] + [(2000, 2000 + i) for i in range(60)] + pairs[:5]
    pairs = [(a, b) for a, b in pairs if a != b]
    found = components.components(spark.createDataFrame(pairs, "a long, b long")).collect()
    wanted = {x: c for x, c in plain_components(pairs).items() if x != c}
    assert {r["node"]: r["component"] for r in found} == wanted


def test_components_of_nothing(spark):
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0
    assert components.components(spark.createDataFrame([(3, 3)], "a long, b long")).count() == 0


def shingle_set(text, width):
    w = words(ascii_lower(text or ""))
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set())


def plain_dedup(rows, width, percent):
    rows = [(d, shingle_set(t, width)) for d, t in rows if d is not None]
    pairs = []
    for i, (a, x) in enumerate(rows):
        for b, y in rows[:i]:
            if a == b or (x and y and 100 * len(x & y) >= percent * len(x | y)):
                pairs.append((a, b))
    linked = plain_components(pairs)
    return {d: linked.get(d, d) for d, _ in rows}


def edited(seed, bases=6, copies=40):
    pick = random.Random(seed)
    rows = []
    for b in range(bases):
        base = prose(b, 90).split()
        for c in range(copies):
            new = list(base)
            for _ in range(pick.randint(0, 5)):
                new[pick.randrange(len(new))] = f"w{pick.randint(0, 10**6)}"
            rows.append((100 + b * copies + c, " ".join(new)))
    return rows


@pytest.mark.parametrize("width,percent,block", [(3, 85, 100_000), (5, 80, 1_500), (3, 100, 100_000)])
def test_near_duplicates_equal_all_pairs(spark, monkeypatch, width, percent, block):
    monkeypatch.setattr(minmax, "BLOCK_SHINGLES", block)
    rows = awkward() + edited(3) + [(6000, "one"), (6001, "ONE"), (6002, "two  words")]
    df = clashing(table(spark, rows), "kept", "component", "n", "group", "node")
    out = minmax.near_duplicates(df, width=width, percent=percent).collect()
    wanted = plain_dedup(rows, width, percent)
    assert len(out) == len(rows)
    assert {r["doc_id"]: r["component_id"] for r in out if r["doc_id"] is not None} == wanted
    assert all(r["kept"] == (r["doc_id"] in (None, r["component_id"])) for r in out)
    sizes = collections.Counter((d, len(shingle_set(t, width))) for d, t in rows)
    assert collections.Counter((r["doc_id"], r["n_shingles"]) for r in out) == sizes


def test_an_id_with_two_texts_links_both(spark):
    a, b = prose(1, 60), prose(2, 60)
    rows = [(5, a), (5, b), (7, a), (9, b), (3, prose(4, 50))]
    out = {r["doc_id"]: r["component_id"] for r in minmax.near_duplicates(table(spark, rows)).collect()}
    assert out == {5: 5, 7: 5, 9: 5, 3: 3}


def test_no_documents(spark):
    assert minmax.near_duplicates(empty(spark)).count() == 0
    only = minmax.near_duplicates(table(spark, [(1, None), (2, ""), (None, None)])).collect()
    assert {(r["doc_id"], r["component_id"], r["n_shingles"], r["kept"]) for r in only} == {
        (1, 1, 0, True), (2, 2, 0, True), (None, None, 0, True)
    }


def test_confirmed_links_in_one_block():
    sets = [np.unique(np.array([hash(s) & (2**63 - 1) for s in shingle_set(t, 3)], np.uint64))
            for _, t in edited(8, bases=3, copies=30)]
    found = plain_components(minmax.confirmed_links(sets, 85))
    pairs = [(i, j) for i in range(len(sets)) for j in range(i)
             if 100 * len(np.intersect1d(sets[i], sets[j])) >= 85 * len(np.union1d(sets[i], sets[j]))]
    assert found == plain_components(pairs)


def test_bands_find_pairs_at_the_threshold():
    for percent in (80, 85, 95):
        share = (percent / 100) ** (2 * minmax.PERMUTATIONS_PER_BAND)
        assert (1 - share) ** minmax.band_count(percent) <= minmax.MISS
    values = np.sort(np.random.default_rng(1).integers(0, 1 << 63, 500, dtype=np.uint64))
    keys = minmax.band_keys(np.concatenate([values, values]), np.array([0, 500, 500, 1000]), 20)
    assert (keys[0] == keys[2]).all() and not keys[1].any()
    assert len(set(keys[0].tolist())) == 20


# --- leaks ------------------------------------------------------------------------------------


def alignment(text, item):
    best = 0
    score = [[0] * (len(item) + 1) for _ in range(len(text) + 1)]
    for i, a in enumerate(text, 1):
        for j, b in enumerate(item, 1):
            score[i][j] = max(
                0, score[i - 1][j - 1] + (2 if a == b else -1), score[i - 1][j] - 1, score[i][j - 1] - 1
            )
            best = max(best, score[i][j])
    return best / (2 * len(item))


def test_alignment_equals_full_table():
    pick = np.random.default_rng(4)
    texts = [pick.integers(0, 6, n) for n in pick.integers(1, 40, 60)]
    items = [pick.integers(0, 6, n) for n in pick.integers(1, 20, 60)]
    wanted = [alignment(t.tolist(), i.tolist()) for t, i in zip(texts, items)]
    assert leaks.align(texts, items).tolist() == pytest.approx(wanted)


def test_leaks(spark):
    items = [(i, prose(500 + i, 20 + i)) for i in range(12)]
    odd_items = [(50, None), (51, ""), (52, "two words"), (None, prose(600, 25)), (3, prose(601, 25))]
    pick = random.Random(2)
    rows = awkward() + [(d, prose(d, 150, 5)) for d in range(700, 760)]
    planted = {}
    for d in range(700, 740):
        item, text = items[pick.randrange(12)]
        new = text.split()
        for _ in range(pick.randint(0, len(new) // 8)):
            place = pick.randrange(len(new))
            kind = pick.random()
            new[place : place + 1] = [] if kind < 0.3 else ["changed"] if kind < 0.7 else [new[place], "added"]
        if d % 4 == 0:
            new = [w.upper() for w in new]
        host = prose(d, 150).split()
        place = pick.randrange(150)
        rows.append((d + 1000, " ".join([*host[:place], *new, *host[place:]])))
        planted[d + 1000] = item
    fragment = items[0][1].split()[:6]
    rows += [(3000, " ".join(prose(1, 30).split() + fragment + prose(2, 30).split()))]
    rows += [(None, items[4][1]), (3001, " ".join([items[5][1], items[6][1], items[5][1]])), (3002, prose(601, 25))]
    rows += [(i, "common start " + items[7][1] + " and end " + str(i)) for i in range(4000, 4080)]
    df = clashing(table(spark, rows), "item_id", "similarity", "words")
    benchmark = spark.createDataFrame(items + odd_items, "item_id long, text string")
    out = leaks.leaks(df, clashing(benchmark, "doc_id")).collect()
    found = {(r["doc_id"], r["item_id"]) for r in out}
    wanted = set(planted.items()) | {(None, 4), (3001, 5), (3001, 6), (3002, 3), (5, 52)}
    wanted |= {(i, 7) for i in range(4000, 4080)}
    assert found == wanted and len(out) == len(found)
    assert all(leaks.SIMILARITY <= r["similarity"] <= 1 for r in out)
    score = {(r["doc_id"], r["item_id"]): r["similarity"] for r in out}
    assert score[3001, 5] == score[None, 4] == 1


def every_leak(rows, items):
    """Leaks by alignment of all documents with all items."""
    ids = {}
    hashed = lambda text: np.array([ids.setdefault(w, len(ids)) for w in text.split()])
    pairs = [(d, i, hashed(t), hashed(x)) for d, t in rows for i, x in items]
    scores = leaks.align([p[2] for p in pairs], [p[3] for p in pairs])
    return {p[:2]: s for p, s in zip(pairs, scores) if s >= leaks.SIMILARITY}


def inside(seed, words):
    host = prose(seed, 60).split()
    return " ".join([*host[:30], *words, *host[30:]])


def check_leaks(spark, rows, items, planted):
    wanted = every_leak(rows, items)
    assert planted <= wanted.keys()
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    out = leaks.leaks(table(spark, rows), benchmark).collect()
    assert {(r[0], r[1]): r[2] for r in out} == pytest.approx(wanted) and len(out) == len(wanted)


def test_leaks_of_edited_copies(spark):
    """Few or no frequent n-grams survive, with verbatim copies of the item elsewhere or without."""
    items = [(i, prose(9000 + i, n)) for i, n in enumerate((15, 38, 38, 59))]
    rows, planted = [], set()
    for i, text in items:
        new = text.split()
        new[4::5] = ["changed"] * len(new[4::5])
        pairs = [y for k, x in enumerate(text.split()) for y in ([x, f"new{k}"] if k % 2 else [x])]
        rows += [(i, inside(i, new)), (10 + i, inside(10 + i, pairs))]
        planted |= {(i, i), (10 + i, i)}
    rows += [(100 + d, inside(100 + d, items[2][1].split())) for d in range(20)]
    pick = random.Random(6)
    for d in range(200, 300):
        i, text = items[pick.randrange(4)]
        new = text.split()
        for _ in range(pick.randint(0, len(new) // 2)):
            place, kind = pick.randrange(len(new)), pick.random()
            new[place : place + 1] = [] if kind < 0.3 else ["changed"] if kind < 0.6 else [new[place], "added"]
        rows.append((d, inside(d, new)))
    check_leaks(spark, rows, items, planted)


def test_leaks_with_long_insertions_and_changed_ends(spark):
    items = [(i, prose(9100 + i, n)) for i, n in enumerate((10, 38, 59))]
    rows, planted = [], set()
    for i, text in items[1:]:
        words, added = text.split(), prose(9200 + i, 22).split()
        half = len(words) // 2
        rows.append((i, inside(i, [*words[:half], *added, *words[half:]])))
        planted.add((i, i))
    ends = items[0][1].split()
    ends[2] = ends[7] = "changed"
    rows += [(10, inside(10, ends)), (11, " ".join(ends)), (12, inside(12, ends[3:7]))]
    check_leaks(spark, rows, items, planted | {(10, 0), (11, 0)})


def test_leaks_of_items_of_any_length(spark):
    """Items of 1 to 60 words, verbatim and edited, equal alignment of all with all."""
    pick = random.Random(8)
    lengths = [1, 2, 2, 3, 4, 5, 6, 7, 9, 14, 30, 60]
    items = [(i, prose(9300 + i, n)) for i, n in enumerate(lengths)]
    items += [(90, "ab ab ab"), (91, "cd ef cd ef"), (92, "gh")]
    rows, planted = [], set()
    for i, text in items:
        words = text.split()
        rows += [(i, inside(i, words)), (100 + i, text), (200 + i, " ".join(words[: len(words) // 2]))]
        planted |= {(i, i), (100 + i, i)}
        for d in range(300 + 20 * i, 320 + 20 * i):
            new = list(words)
            for _ in range(pick.randint(1, 1 + len(new) // 2)):
                place, kind = pick.randrange(len(new) + 1), pick.random()
                new[place : place + 1] = [] if kind < 0.3 else ["changed"] if kind < 0.6 else [*new[place : place + 1], "added"]
            rows.append((d, inside(d, new)))
    rows += [(5000, "ab x ab y ab"), (5001, "ef cd ef"), (5002, "ab " * 300), (5003, "cd " * 50 + "ef cd")]
    check_leaks(spark, rows, items, planted)


def test_leaks_of_nothing(spark):
    items = spark.createDataFrame([(1, "a short test item of words")], "item_id long, text string")
    assert leaks.leaks(empty(spark), items).count() == 0
    nothing = leaks.leaks(table(spark), items.where("false"))
    assert nothing.columns == ["doc_id", "item_id", "similarity"] and nothing.count() == 0


# --- shards -----------------------------------------------------------------------------------


def plain_shard(key, node):
    while node.children:
        if len(node.children) == 1:
            node = node.children[0]
            continue
        def draw(child):
            bits = xxhash.xxh64_intdigest(f"{key}:{child.name}".encode(), 42) >> 11
            return -np.log((bits + 0.5) / 2.0**53) / child.weight
        node = min(node.children, key=draw)
    return node.shard


def shards(spark, ids, tree):
    df = spark.createDataFrame([(i,) for i in ids], "doc_id long")
    return {r[0]: r[1] for r in df.select("doc_id", hash_tree.shard_of(F.col("doc_id"), tree)).collect()}


def test_shard_equals_descent(spark):
    tree = hash_tree.even_tree(2, 2, 2)
    found = shards(spark, range(500), tree)
    assert found == {i: plain_shard(i, tree) for i in range(500)}
    assert min(collections.Counter(found.values()).values()) > 35


def test_one_more_shard_takes_only_into_itself(spark):
    tree = hash_tree.even_tree(2, 2, 2)
    before, after = (shards(spark, range(3000), t) for t in (tree, hash_tree.with_shard(tree, 8)))
    moved = {i for i in before if before[i] != after[i]}
    assert {after[i] for i in moved} == {8} and 230 < len(moved) < 440


def test_weights_move_only_changed_subtrees(spark):
    def tree(weight):
        racks = tuple(
            hash_tree.Node(f"0/{k}", tuple(
                hash_tree.leaf(f"0/{k}/{s}", 2 * k + s, weight if (k, s) == (1, 0) else 1.0) for s in range(2)
            )) for k in range(3)
        )
        return hash_tree.Node("", (hash_tree.Node("0", racks),))
    before, after = shards(spark, range(3000), tree(1.0)), shards(spark, range(3000), tree(4.0))
    moved = [(before[i], after[i]) for i in before if before[i] != after[i]]
    assert moved and all(b // 2 == 1 for _, b in moved)
    share = collections.Counter(after.values())
    assert 0.35 < share[2] / 3000 < 0.55


def test_slots_are_gapless(spark, monkeypatch):
    monkeypatch.setattr(hash_tree, "REPEATS_PER_ROW", 7)
    rows = awkward() + [(i, f"text {i}") for i in range(100, 400)] + [(55, "again")] * 60
    tree = hash_tree.even_tree(2, 2, 2)
    df = clashing(table(spark, rows), "shard", "slot", "size")
    out = hash_tree.with_slots(hash_tree.assign(df, tree)).collect()
    assert len(out) == len(rows)
    by_shard = collections.defaultdict(list)
    for r in out:
        by_shard[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    wanted = collections.Counter(
        (d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows
    )
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == wanted
    ordered = sorted((r for r in out if r["doc_id"] is not None), key=lambda r: (r["shard"], r["slot"]))
    assert all(a["doc_id"] <= b["doc_id"] for a, b in zip(ordered, ordered[1:]) if a["shard"] == b["shard"])
    assert hash_tree.with_slots(hash_tree.assign(empty(spark), tree)).count() == 0
