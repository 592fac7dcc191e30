import random

import pytest
from pyspark.sql import functions as F

from arbora import schema as S
from arbora import store
from arbora.functions import text as X
from arbora.operators import browse as B
from arbora.operators import hierarchy as H
from arbora.operators import listing as L
from arbora.operators import mutate as M
from arbora.operators import repair
from arbora.operators import rollup as R
from arbora.operators import search as Q
from arbora.operators import verify as V
from arbora.plans import catalogue
from arbora.sources import tsv
from arbora.streaming import changelog, effects
from arbora.streaming.deltas import DeltaTable

CHECKED = ["get_link", "get_categories_batch", "list_children_page", "list_links_keyset", "subtree_links_cursor", "subtree_links_all", "ancestors", "breadcrumbs_batch", "slug_paths", "slug_only_index", "resolve_leaf", "browse_path", "postings", "search_and", "search_match_field", "subtree_counts", "category_facet", "tag_chips", "tag_filter", "enrich_links", "dup_urls", "bulk_import_tally", "bulk_status_codes", "bulk_delete_codes", "move_category_counts", "rename_paths", "index_health", "count_drift", "incremental_counts", "changelog_replay", "effects_links", "effects_category_paths", "effects_counts", "bulk_delete_category_codes", "create_submissions", "subtree_links_answer", "subtree_links_answer_cursor", "dashboard_all", "category_year_filter", "search_with_parents", "search_with_status", "formatted_links", "search_stored", "index_health_broken", "index_coverage", "repair_queue", "repair_effects", "update_category", "mutation_effects", "mutation_replay"]


@pytest.mark.parametrize("name", CHECKED)
def test_matches_sql(same, name):
    same(catalogue.queries()[name], catalogue.oracle_sql()[name])


def cats(spark, rows):
    return spark.createDataFrame([(i, p, n, n.lower(), "") for i, p, n in rows], "id long, parent_id long, name string, slug string, description string")


def links(spark, rows):
    return spark.createDataFrame(rows, "id long, category_id long, url string, title string, description string, status int, submitter_id long")


@pytest.fixture(scope="module")
def abc(spark):
    return cats(spark, [(1, 0, "Top"), (2, 1, "A"), (3, 2, "B"), (4, 1, "C")])


def ids(df):
    return [r.id for r in df.collect()]


@pytest.mark.parametrize("n", [64, 70, 300])
def test_deep_trees(spark, n):
    """A chain: the closure has all pairs, and counts and listings reach the whole depth; the paths' own limits hold."""
    chain = cats(spark, [(k, k - 1, f"C{k}") for k in range(1, n + 1)])
    tree = H.closure(chain)
    assert {(r.ancestor, r.descendant, r.depth) for r in tree.collect()} == {(a, d, d - a) for d in range(1, n + 1) for a in range(1, d + 1)}
    assert sorted(ids(H.descendants(H.edges_of(chain), 2))) == list(range(2, n + 1))
    rows = links(spark, [(1, n, "u", "", "", 1, 0)])
    assert {r.link_count_subtree for r in R.subtree_counts(chain, rows, tree).collect()} == {1}
    assert ids(L.subtree_links(rows, tree, 1)) == [1]
    assert len(H.ancestors(tree, n).collect()) == min(64, n - 1)
    assert len(H.category_path(tree, 64).collect()) == 64
    if n > 64:
        with pytest.raises(S.DirectoryError) as error:
            H.category_path(tree, 65)
        assert error.value.status == "path_too_deep"
    if n > 256:
        loose = chain.union(cats(spark, [(1000, 0, "X")]))
        assert M.move_category(loose, 1000, 256).filter("id = 1000").first().parent_id == 256
        with pytest.raises(S.DirectoryError) as error:
            M.move_category(loose, 1000, 257)
        assert error.value.status == "path_too_deep"


def test_closure_of_any_graph(spark):
    """Cycles, orphans, own parents, null parents, repeated rows and a random forest, against a walk in Python."""
    rng = random.Random(1)
    rows = [(1, 3), (2, 1), (3, 2), (4, 3), (5, 4), (6, 99), (7, 0), (8, None), (9, 9), (9, 9)] + [(k, rng.choice([0, 77, rng.randrange(10, 90)])) for k in range(10, 90)]
    parent = {k: p for k, p in rows}
    want = set()
    for k in parent:
        at, depth, seen = k, 0, []
        while at in parent and at not in seen:
            want.add((at, k, depth))
            seen.append(at)
            at, depth = parent[at], depth + 1
    table = spark.createDataFrame(rows, "id long, parent_id long")
    got = H.closure(table).collect()
    assert {(r.ancestor, r.descendant, r.depth) for r in got} == want and len(got) == len(want)
    for root in (1, 10, 77):
        assert sorted(ids(H.descendants(H.edges_of(table), root))) == sorted({d for a, d, _ in want if a == root})
    assert H.closure(table.limit(0)).count() == 0


def test_descendants_and_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (1, 3), (2, 4), (2, 5)], "parent_id long, child_id long")
    assert sorted(ids(H.descendants(edges, 1))) == [1, 2, 3, 4, 5]
    looped = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (2, 3)], "parent_id long, child_id long")
    assert sorted(ids(H.descendants(looped, 1))) == [1, 2, 3]


def test_counts_and_deltas(spark, abc):
    rows = links(spark, [(1, 3, "u1", "", "", 1, 0), (2, 3, "u2", "", "", 1, 0), (3, 2, "u3", "", "", 1, 0)])
    got = {r.id: (r.link_count, r.child_count, r.link_count_subtree, r.child_count_subtree) for r in R.subtree_counts(abc, rows).collect()}
    assert got == {1: (0, 2, 3, 3), 2: (1, 1, 3, 1), 3: (2, 0, 2, 0), 4: (0, 0, 0, 0)}
    less = spark.createDataFrame([(3, -5, 0)], "category_id long, links long, children long")
    assert {r.id: r.link_count_subtree for r in R.apply_deltas(R.subtree_counts(abc, rows), less, H.closure(abc)).collect()} == {1: 0, 2: 0, 3: 0, 4: 0}


def test_resolve(spark):
    paths = H.slug_paths(cats(spark, [(1, 0, "Top"), (2, 1, "A"), (3, 2, "B")]))
    for path, want in {"top": [1], "top/a": [2], "a": [2], "a/b": [3], "b": [3], "": [], "nonexistent": [], "x/a": [], "a/nonexistent": []}.items():
        assert ids(H.resolve(paths, path)) == want


def test_search_and_fields(spark):
    rows = links(spark, [(1, 0, "https://x.example", "Alpha Beta", "", 1, 0), (2, 0, "https://betaword.example", "Alpha Only", "beta", 1, 0)])
    assert ids(Q.search_links(rows, "alpha beta")) == [1, 2] and ids(Q.search_links(rows, "betaword")) == [2] and ids(Q.search_links(rows, "!")) == []
    assert [r.match_field for r in Q.search_links(rows, "betaword").collect()] == [1]
    with pytest.raises(S.DirectoryError):
        Q.search_both(rows, rows, "a")


def test_cursors_submitters_and_limits(spark, abc):
    rows = links(spark, [(i, 0, f"u{i}", "", "", 1, 7) for i in range(1, 6)])
    first = L.page(L.links_by_submitter(rows, 7), limit=2).collect()
    assert [r.id for r in first] == [1, 2] and {r.next_after_id for r in first} == {2}
    assert {r.next_after_id for r in L.page(rows, limit=2, after_id=4).collect()} == {0}
    assert ids(L.links_by_submitter(rows, 0)) == []
    with pytest.raises(S.DirectoryError):
        L.subtree_page(rows, H.closure(abc), 1, offset=5001)
    with pytest.raises(S.DirectoryError):
        H.check_batch([1] * 201)


def test_mutations(spark, abc):
    rows = links(spark, [(1, 2, "u1", "", "", 0, 0)])
    items = spark.createDataFrame([(0, 2, "n1", "", ""), (1, 2, "n1", "", ""), (2, 9, "n2", "", ""), (3, 0, "u1", "", ""), (4, 2, "x" * 65, "", "")], "pos long, category_id long, url string, title string, description string")
    got = M.create_links(rows, abc, items)
    assert [r.status for r in got.items.orderBy("pos").collect()] == ["ok", "duplicate_url", "category_not_found", "duplicate_url", "field_too_long"]
    assert got.table.count() == 2 and M.bulk_tally(got).first().first_id == 2
    with pytest.raises(S.DirectoryError):
        M.move_category(abc, 2, 3)
    with pytest.raises(S.DirectoryError):
        M.delete_category(abc, rows, 2)
    assert M.delete_category(abc, rows, 4)[0].count() == 3


def test_drift_orphans(spark, abc):
    pairs = spark.createDataFrame([(1000, 950), (1000, 1000), (0, 0), (1000, 1100)], "e long, o long")
    assert [r.d for r in pairs.select(X.drift_bp(F.col("o"), F.col("e")).alias("d")).collect()] == [500, 0, 0, 1000]
    assert ids(V.orphans(abc.filter("id != 2"))) == [3]


def test_tsv(spark, tmp_path):
    (tmp_path / "c.tsv").write_text("Top/A\tTop\tA\ta\nTop/A/B\tTop/A\tB\tb\nTop/X/Y\tTop/X\tY\ty\n")
    (tmp_path / "l.tsv").write_text("Top/A\thttp://a\tt\td\nTop/Q\thttp://b\tt\td\nTop/A/B\thttp://a\tt\td\n")
    found = tsv.import_categories(tsv.read_tsv(spark, str(tmp_path / "c.tsv"), ["path", "parent_path", "name", "slug"]))
    assert sorted(r.path for r in found.collect()) == ["Top", "Top/A", "Top/A/B"]
    rows = tsv.read_tsv(spark, str(tmp_path / "l.tsv"), ["topic", "url", "title", "description"])
    assert [r.url for r in tsv.import_links(rows, found).collect()] == ["http://a"]


def test_numbered(spark):
    rows = spark.createDataFrame([(p,) for p in (5, 0, 2**20, 3 * 2**33 + 1, 2**33, 7)], "pos long")
    assert [tuple(r) for r in M.numbered(rows, 10).orderBy("pos").collect()] == [(p, 11 + k) for k, p in enumerate(sorted((5, 0, 2**20, 3 * 2**33 + 1, 2**33, 7)))]
    assert M.numbered(rows.limit(0)).count() == 0


def test_delete_categories_in_order(spark, abc):
    rows = links(spark, [(1, 3, "u1", "", "", 1, 0), (2, None, "u2", "", "", 1, 0), (3, 4, "u3", "", "", 1, 0)])
    left, kept, codes = M.delete_categories(abc, rows, [2, 3, 2, 9, 2])
    assert [r.status for r in codes.orderBy("pos").collect()] == ["has_children", "ok", "ok", "not_found", "not_found"]
    assert sorted(ids(left)) == [1, 4] and sorted(ids(kept)) == [2, 3]
    assert M.delete_categories(abc, rows, [])[0].count() == 4


def test_move_checks(spark, abc):
    for category, parent, status in ((9, 1, "category_not_found"), (2, 9, "parent_not_found"), (2, 3, "circular_reference"), (2, 2, "circular_reference")):
        with pytest.raises(S.DirectoryError) as error:
            M.move_category(abc, category, parent)
        assert error.value.status == status
    assert sorted(r.parent_id for r in M.move_category(abc, 2, 1).collect()) == [0, 1, 1, 2]


RECORD = "seq long, op int, record struct<id long, category_id long, title string>"


def test_effects_repeat_and_come_late(spark):
    table = spark.createDataFrame([(1, 5, "a"), (2, 5, None)], "id long, category_id long, title string")
    log = spark.createDataFrame([(3, 2, (1, 5, "a")), (2, 3, (1, 5, "late")), (4, 4, (2, 6, None)), (4, 4, (2, 6, None)), (5, 1, (3, 6, "c")), (6, 20, (2, 0, None))], RECORD)
    assert sorted(tuple(r) for r in effects.apply_effects(table, log, "link").collect()) == [(2, 6, None), (3, 6, "c")]
    assert effects.apply_effects(table, log.limit(0), "link").count() == 2
    with pytest.raises(Exception, match="unknown op 99"):
        effects.apply_effects(table, log.withColumn("op", F.lit(99)), "link").collect()
    cats_ = spark.createDataFrame([(5, 0)], "id long, parent_id long")
    found = effects.deltas((table, effects.apply_effects(table, log, "link")), (cats_, cats_.limit(0)))
    assert sorted(tuple(r) for r in found.collect()) == [(0, 0, -1), (5, -2, 0), (6, 2, 0)]


def test_effect_stream_equals_batch(spark, tmp_path):
    """One file a batch, shuffled, some effects twice, then a restart without and one with new effects."""
    table = spark.createDataFrame([(k, 0, "t") for k in range(4)], "id long, category_id long, title string")
    effects_ = [(n, [3, 4, 2, 1][n % 4], (n * 7 % 6, n, f"t{n}")) for n in range(80)]
    random.Random(3).shuffle(effects_)
    log_dir, sink = str(tmp_path / "log"), effects.EffectSink(spark, str(tmp_path / "state"), table, "link")
    assert sorted(effects.rows(sink.state(-1)).collect()) == sorted(table.collect())
    log = spark.createDataFrame(effects_[:60] + effects_[5:9], RECORD)
    log.repartition(5).write.parquet(log_dir)
    last = sink.run(log_dir, RECORD, str(tmp_path / "check"))
    assert last >= 3 and sorted(effects.rows(sink.state(last)).collect()) == sorted(effects.apply_effects(table, log, "link").collect())
    sink = effects.EffectSink(spark, str(tmp_path / "state"), table, "link")
    assert sink.run(log_dir, RECORD, str(tmp_path / "check")) == last
    more = spark.createDataFrame(effects_[60:], RECORD)
    more.coalesce(1).write.mode("append").parquet(log_dir)
    again, want = sink.run(log_dir, RECORD, str(tmp_path / "check")), sorted(effects.apply_effects(table, log.union(more), "link").collect())
    assert again == last + 1 and sorted(effects.rows(sink.state(again)).collect()) == want
    assert sorted(effects.rows(effects.advance(sink.state(again), log, "link")).collect()) == want


def test_stream_equals_replay(spark, tmp_path):
    """One file a batch: late and repeated changes count once, also after a restart; a strange checkpoint is refused."""
    schema = "seq long, op string, link_id long"
    changes_ = [(5, "approve", 9), (2, "insert", 9), (3, "delete", 9), (3, "delete", 9), *((i, ["insert", "approve", "delete"][i % 3], i % 5) for i in range(10, 60))]
    log_dir = str(tmp_path / "log")
    for k in range(0, len(changes_), 9):
        spark.createDataFrame(changes_[k : k + 9][::-1], schema).coalesce(1).write.mode("append").parquet(log_dir)
    spark.createDataFrame(changes_[:20], schema).coalesce(1).write.mode("append").parquet(log_dir)
    sink = changelog.ChangeLogSink(spark, str(tmp_path / "state"))
    last = sink.run(log_dir, schema, str(tmp_path / "check"))
    want = sorted(changelog.replay(spark.read.parquet(log_dir)).collect())
    assert last >= 5 and sorted(sink.state(last).collect()) == want and {r.link_id: r.changes for r in want}[9] == 3
    sink = changelog.ChangeLogSink(spark, str(tmp_path / "state"))
    assert sink.run(log_dir, schema, str(tmp_path / "check")) == last
    spark.createDataFrame([(1, "insert", 9), (5, "approve", 9)], schema).coalesce(1).write.mode("append").parquet(log_dir)
    last = sink.run(log_dir, schema, str(tmp_path / "check"))
    assert {r.link_id: (r.last_seq, r.changes) for r in sink.state(last).collect()}[9] == (5, 4)
    assert sorted(sink.state(last).collect()) == sorted(changelog.replay(spark.read.parquet(log_dir)).collect())
    with pytest.raises(ValueError, match="checkpoint"):
        sink.run(log_dir, schema, str(tmp_path / "other"))


def test_deltas_fold(spark, tmp_path):
    """Many batches leave few folders; a batch that comes again changes nothing."""
    table = DeltaTable(spark, str(tmp_path), "k long, v long", "k", most=4)
    assert table.last() == -1 and table.rows(5).count() == 0
    for n in range(12):
        table.put(n, spark.createDataFrame([(n % 3, n), (100 + n, n)], "k long, v long"))
        table.put(n, spark.createDataFrame([(0, -1)], "k long, v long"))
    assert table.last() == 11 and {r.k: r.v for r in table.rows(11).collect()} == {0: 9, 1: 10, 2: 11} | {100 + n: n for n in range(12)}
    assert len([p for p in tmp_path.iterdir() if "=" in p.name]) < 12


def test_log_of_mutations(spark, tmp_path):
    """Mutations append effects; the log's replay over the first version is the last version."""
    first = spark.createDataFrame([(k, 1 + k % 2, f"u{k}", "t", "", 1) for k in range(6)], "id long, category_id long, url string, title string, description string, status int")
    cats_ = cats(spark, [(1, 0, "Top"), (2, 1, "A")])
    steps = [M.update_text(first, 1, "link", title="new").table]
    steps.append(M.move_links(steps[-1], cats_, [1, 2], 2).table)
    steps.append(M.delete_links(steps[-1], [3]).table)
    items = spark.createDataFrame([(0, 2, "n", "t", "")], "pos long, category_id long, url string, title string, description string")
    steps.append(M.create_links(steps[-1].withColumn("submitter_id", F.lit(0).cast("long")), cats_, items).table.select(*first.columns))
    seqs = [effects.append(str(tmp_path), a, b, "link") for a, b in zip([first, *steps[:-1]], steps, strict=True)]
    assert seqs == [1, 2, 3, 4] and effects.append(str(tmp_path), steps[-1], steps[-1], "link") == 4
    log = spark.read.parquet(str(tmp_path / "link"))
    assert [r.op for r in log.orderBy("seq").collect()] == [3, 4, 2, 1]
    assert sorted(effects.apply_effects(first, log, "link").collect()) == sorted(steps[-1].collect())
    moved = M.move_category(M.rename_category(cats_, 2, "aa"), 2, 0)
    assert sorted(r.op for r in effects.between(cats_, moved, "category").collect()) == [13, 14]


def test_browse(spark, abc):
    rows = links(spark, [(1, 3, "u1", "", "", 1, 0), (2, 2, "u2", "", "", 1, 0)])
    page = B.browse(abc, rows, "top/a")
    assert (page.id, ids(page.ancestors), ids(page.children), page.total.first().total_links) == (2, [1], [3], 2)
    assert B.browse(abc, rows, "c").rows().filter("part = 'total_links'").first().id == 0
    for path in ("", "nowhere", "top/a/c"):
        with pytest.raises(S.DirectoryError) as error:
            B.browse(abc, rows, path)
        assert error.value.status == "not_found"


def test_subtree_answers(spark):
    """The fixture of three categories with ten links each, in pages of 15; an unknown root; cursors to the end."""
    tree = H.closure(cats(spark, [(1, 0, "Top"), (2, 1, "A"), (3, 1, "B")]))
    rows = links(spark, [(c * 100 + n, c, f"u{c}{n}", "", "", n % 3, 0) for c in (1, 2, 3) for n in range(1, 11)])
    first, second = (L.subtree_answer(rows, tree, 1, offset=o, limit=15) for o in (0, 15))
    assert ids(first.rows)[0] == 101 and ids(second.rows)[0] == 206
    assert tuple(first.summary.first()) == (30, 15, 205) and tuple(second.summary.first()) == (30, 15, 0)
    assert tuple(L.subtree_answer(rows, tree, 99).summary.first()) == (0, 0, 0)
    seen, after = [], 0
    while True:
        page = L.subtree_answer(rows, tree, 1, limit=4, status=2, after_id=after)
        seen += ids(page.rows)
        total, _, after = page.summary.first()
        if not after:
            break
    assert total == len(seen) == 9 and seen == sorted(seen)
    assert tuple(L.subtree_answer(rows, tree, 1, after_id=12345).summary.first()) == (30, 0, 0)


def test_requests():
    assert [L.parse_extras(x) for x in (b"", b"\x01", b"\xff" + bytes([7]) + bytes(7), b"\x02" + bytes([1, 1]) + bytes(6))] == [(None, 0), (1, 0), (None, 7), (2, 257)]
    for bad in (b"\x03", b"\xff", b"\x01\x02", bytes([3]) + bytes(8), bytes(10)):
        with pytest.raises(S.DirectoryError):
            L.parse_extras(bad)
    assert [L.web_page(n) for n in (0, 1, 3, 101, 102)] == [(0, False), (0, False), (100, False), (5000, False), (5050, True)]


def test_scalars(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    text = lambda v: F.lit(v).cast("string")
    at = lambda v: F.lit(v).cast("timestamp")
    cases = [
        (X.truncate(text("one two three"), 4), "one…"), (X.truncate(text("one"), 3), "one"), (X.pad(F.lit(5), 2), "05"), (X.pad(F.lit(12345678), 7), "12345678"),
        (X.long_date(at("2026-05-10 01:00:00")), "May 10, 2026"), (X.long_date(at("1970-01-01 00:00:00")), None), (X.long_date_or_dash(at("1970-01-01 00:00:00")), "—"), (X.month_year(at("2026-08-02")), "Aug 2026"),
        *((X.relative_time(F.lit(1000 - 0), F.lit(1000 + gap)), want) for gap, want in ((2, "2s ago"), (300, "5m ago"), (3 * 3600 + 5, "3h ago"), (12 * 86400, "12d ago"))), (X.relative_time(F.lit(0), F.lit(9)), "never"),
        (X.dash_or_value(text("")), "—"), (X.dash_or_value(text(None)), "—"), (X.dash_or_value(text("a")), "a"), (X.slugify(text("--Visual & Arts!")), "visual-arts"), (X.display_name(text("Visual_Arts")), "Visual Arts"),
        (X.is_http_url(text("HTTPS://a")), True), (X.is_http_url(text("ftp://a")), False), (X.path_depth(text("a/b/c")), 2), (X.safe_hostname(text("no url")), "no url"), (X.safe_hostname(text("https://h.x/y")), "h.x"),
        (X.valid_submission(text("t"), text("d" * 30), text("http://a"), F.lit(1)), True), (X.valid_submission(text("t"), text("d" * 29), text("http://a"), F.lit(1)), False), (X.valid_submission(text("t"), text("d" * 30), text("http://a"), F.lit(0)), False),
    ]
    assert [one(c) for c, _ in cases] == [want for _, want in cases]
    assert X.highlight_tokens("foo_bar, a x2") == ["foo_bar", "x2"] and X.query_tokens("A b2 b2 Zig") == ["b2", "zig"]
    assert one(X.path_label(F.array(*map(F.lit, ("Top", "A", "B", "C", "D", "E"))))) == "A › … › D › E"

    def fold(user):
        times = lambda a, b: (a * b) & 0xFFFFFFFF
        high, low = 3735928559, 1103547991
        for c in map(ord, user):
            high, low = times(high ^ c, 2654435761), times(low ^ c, 1597334677)
        high, low = times(high ^ (high >> 16), 2246822507), times(low ^ (low >> 13), 3266489909)
        return ((high * 65536 + low) & 0xFFFFFFFF) or 1

    users = ["", "a", "7f1c2d9e-0b1a-4c3d-8e5f-112233445566", "x" * 200]
    rows = spark.createDataFrame([(u,) for u in users], "u string")
    assert [r.x for r in rows.select(X.submitter_id(F.col("u")).alias("x")).collect()] == [fold(u) for u in users]
    assert rows.select(F.count_distinct(X.url_hash(F.col("u")))).first()[0] == 4


def test_facet_labels(spark):
    table = cats(spark, [(1, 0, "Top"), (2, 1, "Visual_Arts")])
    rows = links(spark, [(1, 2, "u", "", "", 1, 0), (2, 9, "v", "", "", 1, 0)])
    assert [(r.label, r.n) for r in Q.category_facet(rows, table).collect()] == [("Visual Arts", 1)]


def test_search_scopes(spark, abc):
    rows = links(spark, [(k, 2, f"u{k}", "alpha", "", k % 3, 0) for k in range(120)])
    assert Q.search_with_status(rows, "alpha", 1).count() == 17 and Q.search_with_status(rows, "alpha").count() == 50
    both = Q.search_both(rows, abc, "alpha")
    assert sorted(both) == ["categories", "links"] and sorted(Q.search_both(rows, abc, "alpha", 1)) == ["links"] and sorted(Q.search_both(rows, abc, "alpha", 2)) == ["categories"]
    with pytest.raises(S.DirectoryError):
        Q.search_both(rows, abc, "alpha", 3)
    assert [tuple(r) for r in Q.search_with_parents(cats(spark, [(1, 0, "Top"), (2, 1, "Arts"), (3, 2, "Music")]), "music").collect()] == [(3, "Music", "music", 2, "Top / Arts")]
    assert Q.search_with_parents(abc, "x").count() == 0


def test_update_and_create_categories(spark, abc):
    got = M.update_category(abc, 2, name="Other", slug="other", description="d")
    assert got.items.first().status == "ok" and tuple(got.table.filter("id = 2").first()) == (2, 1, "Other", "other", "d")
    assert [M.update_category(abc, key, slug=slug).items.first().status for key, slug in ((99, "x"), (2, "x" * 129))] == ["category_not_found", "field_too_long"]
    chain = cats(spark, [(k, k - 1, f"C{k}") for k in range(1, 67)])
    items = spark.createDataFrame([(0, 64, "x", "x", ""), (1, 65, "x", "x", ""), (2, 0, "x", "x", ""), (3, 99, "x", "x", ""), (4, 1, "x" * 65, "x", "")], "pos long, parent_id long, name string, slug string, description string")
    assert [r.status for r in M.create_categories(chain, items).items.orderBy("pos").collect()] == ["ok", "path_too_deep", "ok", "parent_not_found", "field_too_long"]


def test_repair_is_idempotent(spark, abc):
    stored = H.slug_paths(abc).select("path", "id")
    renamed = M.update_category(abc, 2, slug="aa").table
    queue = repair.enqueue(spark.createDataFrame([], S.REPAIR_TASK), 2, repair.RENAMED, "top/a", 5)
    after, left, effects_ = repair.tick(stored, renamed, queue, size=1)
    want = {("top", 1), ("top/aa", 2), ("top/aa/b", 3), ("top/c", 4)}
    assert {tuple(r) for r in after.collect()} == want and left.count() == 0 and sorted(r.op for r in effects_.collect()) == [20, 20, 21]
    assert {tuple(r) for r in repair.tick(after, renamed, queue)[0].collect()} == want
    waiting = repair.enqueue(queue, 4, repair.MOVED, "top/c", 6)
    assert [r.seq for r in repair.tick(stored, renamed, waiting, most=1)[1].collect()] == [2]


def test_snapshots_and_bootstrap(spark, tmp_path):
    table = tsv.bootstrap(spark)
    assert [tuple(r) for r in table.collect()] == [(1, 0, "Top", "top"), (2, 1, "Lost and Found", "lost-and-found")]
    done = tsv.write_snapshot(table, str(tmp_path), 3)
    assert done["seq"] == 3 and done["duration_ms"] >= 0 and spark.read.parquet(done["path"]).count() == 2
    for blocked in (lambda: None, (tmp_path / "snapshot.lock").touch):
        blocked()
        with pytest.raises(S.DirectoryError) as error:
            tsv.write_snapshot(table, str(tmp_path), 3 if not (tmp_path / "snapshot.lock").exists() else 4)
        assert error.value.status == "already_in_progress"


def test_places_in_several_files(spark, tmp_path):
    """Rows are placed by file and line, however Spark packs the files."""
    for name, n in (("a", 3), ("b", 400), ("c", 2)):
        (tmp_path / f"{name}.tsv").write_text("".join(f"{name}{k}\tx\n" for k in range(n)))
    got = [r.k for r in tsv.read_tsv(spark, str(tmp_path), ["k", "v"]).orderBy("pos").collect()]
    assert got == [f"{name}{k}" for name, n in (("a", 3), ("b", 400), ("c", 2)) for k in range(n)]


def test_tree_cache(spark, abc):
    cache = H.TreeCache()
    first = cache.get(1, abc)
    assert cache.get(1, abc) is first and cache.get(2, abc) is not first
    cache.clear()
    assert cache.tree is None


def test_store_needs_a_shared_folder(spark, monkeypatch):
    """On a cluster without spark.checkpoint.dir nothing is written to a machine's own disk."""
    conf = {"spark.master": "spark://host:7077"}
    fake = type("Session", (), {"conf": type("Conf", (), {"get": staticmethod(lambda k, d=None: conf.get(k, d))})()})()
    with pytest.raises(RuntimeError, match="checkpoint"):
        store.shared_dir(fake)
    conf["spark.checkpoint.dir"] = "hdfs://x/shared/"
    assert store.shared_dir(fake) == "hdfs://x/shared"
    with store.scratch(spark) as folder:
        kept = store.saved(spark.range(3), "rows")
        assert kept.count() == 3 and store.exists(spark, folder)
    assert not store.exists(spark, folder)
