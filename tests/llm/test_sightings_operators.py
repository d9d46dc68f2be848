"""Problems 1, 3 and 4 against brute force, with nulls, repeats, ties, empty tables and clashing columns."""

import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta
from itertools import combinations

from loamgraph.llm import cooccurrence, sightings, term_frequency, top_n

SCHEMA = "entity_id string, path string, chunk_index int, surface string, cnt bigint, seen_at timestamp, arrived_at timestamp, term string, `rank` int, mark string, sign int, bucket int"
DAY = datetime(2025, 1, 1)


def row(e, p, i, s, n, day=0, late=0):
    return (e, p, i, s, n, None if day is None else DAY + timedelta(days=day), DAY + timedelta(days=late), "x", 7, "y", 3, 1)


def made(seed=3, n=600):
    rnd = random.Random(seed)
    rows = []
    for _ in range(n):
        e = "entity:hot" if rnd.random() < 0.35 else f"entity:{rnd.randrange(12)}"
        s = rnd.choice(["Alpha Beta", "alpha  BETA ", "\tGamma", "Delta-1", "é É", " "])
        rows.append(row(rnd.choice([e, e, e, e, None]), rnd.choice(["a.md", "b/c.md", None]), rnd.choice([0, 1, 2, 3, None]), rnd.choice([s, s, s, None]), rnd.choice([0, 1, 1, 2, 5, None]), rnd.choice([0, 1, 2, None]), rnd.randrange(3)))
    return rows + rows[:50]


def current_of(rows):
    best = {}
    for e, p, i, s, n, seen, arrived, *_ in rows:
        if None in (e, p, i, s):
            continue
        key = (seen is not None, seen or DAY, arrived, n is not None, n or 0)
        if (e, p, i, s) not in best or key > best[e, p, i, s][0]:
            best[e, p, i, s] = (key, n)
    return {k: n for k, (_, n) in best.items() if n is not None and n > 0}


def test_current_sightings(spark):
    rows = made()
    found = {tuple(r)[:4]: r["cnt"] for r in sightings.current_sightings(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found == current_of(rows)


def test_term_frequencies(spark):
    rows = made()
    table = term_frequency.term_frequencies(sightings.current_sightings(spark.createDataFrame(rows, SCHEMA)), common_share=0.5)
    occurrences, records, every = Counter(), defaultdict(set), set()
    for (_, p, i, s), n in current_of(rows).items():
        t = " ".join(s.split()).lower()
        occurrences[t] += n
        records[t].add((p, i))
        every.add((p, i))
    found = {r["term"]: (r["occurrences"], r["n_records"], r["mark"]) for r in table.collect()}
    assert set(found) == set(occurrences)
    for t, (n, r, mark) in found.items():
        assert (n, r) == (occurrences[t], len(records[t]))
        assert mark == ("rare" if r < 3 or n < 5 else "common" if r > 0.5 * len(every) else None)


def test_term_runs_are_scanned_in_order(spark):
    plan = term_frequency.term_frequencies(sightings.current_sightings(spark.createDataFrame(made(), SCHEMA)))._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" in plan and plan.count("SortAggregate") >= 3


def test_empty_tables(spark):
    none = sightings.current_sightings(spark.createDataFrame([], SCHEMA))
    assert none.count() == term_frequency.term_frequencies(none).count() == top_n.strongest_sightings(none).count() == 0
    table = cooccurrence.PairTable(spark).apply(cooccurrence.sighting_baskets(none))
    assert table.version == 0 and table.associations().count() == 0


def test_true_mentions(spark):
    current = sightings.current_sightings(spark.createDataFrame([row("e1", "a", 0, "x", 3), row("e1", "a", 1, "x", 4)], SCHEMA))
    ents = spark.createDataFrame([("e1", 1, "n"), ("e2", None, "n"), (None, 5, "n")], "id string, mentions bigint, n string")
    assert {tuple(r) for r in term_frequency.true_mentions(ents, current).collect()} == {("e1", 1, 7), ("e2", None, 0)}


def test_top_n(spark):
    rows = made(5, 900)
    current = current_of(rows)
    by_entity = defaultdict(list)
    for (e, p, i, s), n in current.items():
        by_entity[e].append((-n, p.encode(), i, s.encode()))
    frame = sightings.current_sightings(spark.createDataFrame(rows, SCHEMA))
    for n in (1, 3, 16):
        want = {(e, p.decode(), i, s.decode(), k + 1) for e, items in by_entity.items() for k, (_, p, i, s) in enumerate(sorted(items)[:n])}
        assert {(r["entity_id"], r["path"], r["chunk_index"], r["surface"], r["rank"]) for r in top_n.strongest_sightings(frame, n).collect()} == want
        larger = {w for w in want if len(by_entity[w[0]]) > n}
        assert {(r["entity_id"], r["path"], r["chunk_index"], r["surface"], r["rank"]) for r in top_n.strongest_sightings(frame, n, only_larger=True).collect()} == larger


def test_top_n_prunes_before_the_shuffle(spark):
    plan = top_n.strongest_sightings(sightings.current_sightings(spark.createDataFrame(made(), SCHEMA)), only_larger=True)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_sightings_column_is_in_rank_order(spark):
    rows = [row("e", "a", i, "s", n) for i, n in enumerate([1, 5, 3, 5])]
    nested = top_n.sightings_column(sightings.current_sightings(spark.createDataFrame(rows, SCHEMA)), 3).first()["sightings"]
    assert [(s["chunk_index"], s["cnt"]) for s in nested] == [(1, 5), (3, 5), (2, 3)]


def pairs_of(baskets):
    together, alone = Counter(), Counter()
    for items in baskets.values():
        alone.update(items)
        together.update(combinations(sorted(items), 2))
    return together, alone, len([1 for b in baskets.values() if b])


def as_rows(baskets):
    return [(p, i, x) for (p, i), items in baskets.items() for x in (items or [None])]


BASKET = "path string, chunk_index int, item string"


def check(table, baskets):
    together, alone, total = pairs_of(baskets)
    if table.version:
        kept = {(r["item_a"], r["item_b"]): (r["n"], r["n_a"], r["n_b"]) for r in table.associations(min_together=table.scored_from).collect()}
        assert kept == {(a, b): (n, alone[a], alone[b]) for (a, b), n in together.items() if n >= table.scored_from}
    found = {(r["item_a"], r["item_b"]): r for r in table.associations().collect()}
    assert {k: r["n"] for k, r in found.items()} == together
    assert table.total == total and {r["item"]: r["n"] for r in table.marginals().collect()} == alone
    for (a, b), r in found.items():
        assert abs(r["lift"] - r["n"] * total / (alone[a] * alone[b])) < 1e-9


def test_pair_table_takes_changes(spark):
    rnd = random.Random(9)
    baskets = {(f"p{i % 5}", i): set(rnd.sample("abcdefghij", rnd.randrange(0, 6))) for i in range(40)}
    table = cooccurrence.PairTable(spark, bucket_rows=5, score_batches=2, scored_from=3).apply(spark.createDataFrame(as_rows(baskets) * 2 + [(None, 1, "a"), ("p0", None, "b")], BASKET))
    check(table, baskets)
    first = dict(table.buckets)
    for n in (7, 3, 40):
        more = {(f"q{i}", i): set(rnd.sample([f"i{k:02d}" for k in range(40)], 6)) for i in range(n)}
        changed = {k: set(rnd.sample("abcdefghijkl", rnd.randrange(0, 6))) for k in rnd.sample(sorted(baskets), 7)} | more
        baskets |= changed
        table.apply(spark.createDataFrame(as_rows(changed), BASKET))
        check(table, baskets)
    assert table.buckets["pairs"] > first["pairs"]
    again = cooccurrence.PairTable(spark, table.root, bucket_rows=5, scored_from=3)
    assert again.version == 4 and again.buckets == table.buckets and again.rows == table.rows
    check(again, baskets)
    check(again.apply(spark.createDataFrame([(p, i, None) for p, i in baskets], BASKET)), dict.fromkeys(baskets, set()))


def test_scores_of_untouched_pairs_are_not_computed_again(spark):
    table = cooccurrence.PairTable(spark, scored_from=1).apply(spark.createDataFrame(as_rows({("p", 0): {"a", "b"}, ("p", 1): {"c", "d"}, ("p", 2): {"d", "e"}}), BASKET))
    table.apply(spark.createDataFrame(as_rows({("p", 1): {"c", "x"}}), BASKET))
    fresh = spark.read.parquet(f"{table.root}/scores/v=000002").collect()
    assert {(r["item_a"], r["item_b"], r["n"]) for r in fresh} == {("c", "d", 0), ("c", "x", 1), ("d", "e", 1)}
    check(table, {("p", 0): {"a", "b"}, ("p", 1): {"c", "x"}, ("p", 2): {"d", "e"}})


def test_large_baskets_are_split(spark):
    items = [f"i{n:03d}" for n in range(150)]
    rows = spark.createDataFrame([("p", 0, x, 1) for x in items], "path string, chunk_index int, item string, sign int")
    found = cooccurrence.signed_pairs(rows, split_at=20)
    assert {(r["item_a"], r["item_b"]): r["n"] for r in found.collect()} == dict.fromkeys(combinations(items, 2), 1)
