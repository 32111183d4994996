"""Groups, searches, time and streams on small tables with known results."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F
from hypothesis import given, settings
from hypothesis import strategies as st

from mailquarry.operators.query import field_postings
from mailquarry.operators import dedup, entities, fulltext, groups, search, timeline
from mailquarry.streaming import windows


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.sets(st.sampled_from("abcdef"), min_size=1, max_size=4), st.integers(1, 50)), min_size=1, max_size=12), st.integers(1, 5))
def test_greedy_reaches_its_target(raw, n):
    found = groups.greedy([(tuple(sorted(g)), float(v)) for g, v in raw], n)
    assert len(found) <= max(n, 0) or len(found) <= len(raw)
    assert len(found) <= n
    assert {x for g, _ in found for x in g} <= {x for g, _ in raw for x in g}


def test_greedy_unites_close_groups():
    found = groups.greedy([(("a", "b", "c"), 10.0), (("a", "b", "d"), 9.0), (("x", "y"), 30.0)], 2)
    assert found == [(("x", "y"), 30.0), (("a", "b", "c", "d"), 19.0)]


def test_size_classes(spark):
    rows = spark.createDataFrame([(s,) for s in (1, 5119, 5120, 20480, 102400, 2 << 20)], "size long")
    counts = {c: rows.where(search.size_in((c,))).count() for c in "123459"}
    assert counts == {"1": 2, "2": 1, "3": 1, "4": 1, "5": 1, "9": 6}


def test_numbers():
    assert search.numbers("2-4, 9, 50", 10) == [(2, 4), (9, 9)] and search.numbers("all", 3) == [(0, 2)] and search.alternatives(" A;b ;;") == ["a", "b"]


def test_histogram_counts_every_row(spark):
    days = [datetime(2001, 1, 1), datetime(2001, 2, 1), datetime(2001, 2, 2), datetime(2001, 4, 30)]
    rows = spark.createDataFrame([(d,) for d in days], "date timestamp_ntz")
    out = {str(r["bucket"])[:7]: r["n"] for r in timeline.histogram(rows).collect()}
    assert out == {"2001-01": 2, "2001-02": 1, "2001-04": 1}
    assert [r["n"] for r in timeline.buckets(rows).orderBy("bucket").collect()] == [1, 2, 0, 1]
    assert timeline.valid(rows.unionByName(spark.createDataFrame([(datetime(1960, 1, 1),)], "date timestamp_ntz"))).count() == 4


def test_merge_and_cursor(spark):
    mine, other = spark.createDataFrame([(1, "a")], "id int, x string"), spark.createDataFrame([(1, "b"), (2, "c")], "id int, x string")
    assert sorted(map(tuple, dedup.merged(mine, other, ["id"]).collect())) == [(1, "a"), (2, "c")]
    cursor = spark.createDataFrame([("a", "f", 5)], "account string, folder string, last_uid int")
    seen = spark.createDataFrame([("a", "f", 3), ("a", "g", 1)], "account string, folder string, uid int")
    assert {tuple(r) for r in dedup.advanced_cursor(cursor, seen).collect()} == {("a", "f", 5), ("a", "g", 1)}


def test_capitalised(spark):
    rows = spark.createDataFrame([(1, "the Bank of America met Jane Doe with IBM in may.")], "doc_id int, body string")
    assert {r["display"] for r in entities.mentions(rows, "body").collect()} == {"Bank of America", "Jane Doe", "IBM"}
    rows = spark.createDataFrame([(2, "Suddenly it rained. However, we met (Sandra) and Mary Smith. Then\nApple paid what APPLE owed; apple won. NATO came. Über den Rhein by Wien"), (3, None), (4, "")], "doc_id int, body string")
    assert {r["display"] for r in entities.mentions(rows, "body").collect()} == {"Sandra", "Mary Smith", "APPLE", "NATO", "Rhein", "Wien"}
    short = spark.createDataFrame([(1, "irs", "IRS"), (1, "x", "Internal Revenue Service")], "doc_id int, entity string, display string")
    assert [tuple(r) for r in entities.merged_acronyms(short).collect()] == [("IRS", "Internal Revenue Service")]


def test_phrases_need_neighbours(spark):
    rows = spark.createDataFrame([(1, "deep blue sea"), (2, "blue deep sea"), (3, "deep the blue")], "doc_id int, body string")
    found = fulltext.postings(rows, "body")
    hits = lambda q: sorted(r["doc_id"] for r in fulltext.holding(found, q).collect())
    assert hits('"deep blue"') == [1] and hits("+deep -sea") == [3] and hits("sea|nothing") == [1, 2]


def test_query_language(spark):
    rows = spark.createDataFrame([(1, "state of the art work"), (2, "re de la eau"), (3, "de la mer"), (4, "re alone here"), (5, "art of state"), (6, None), (7, "")], "doc_id int, body string")
    found = fulltext.postings(rows, "body")
    hits = lambda q: sorted(r["doc_id"] for r in fulltext.holding(found, q).collect())
    assert hits('"state of the art"') == [1] and hits('"state art"') == [] and hits('"the state"') == [1, 5]
    assert hits('+re "de la"') == [2, 4] and hits('+re +"de la"') == [2] and hits('-eau "de la"') == [3]
    assert hits("(re OR mer) AND NOT eau") == [3, 4] and hits("re AND la") == [2] and hits("NOT re") == [] and hits("") == [] and hits("the") == []
    assert hits("al?ne OR m*r") == [3, 4] and hits("(re") == [2, 4] and hits("re)") == [2, 4] and hits('"') == []
    fields = field_postings(rows.withColumn("subject", F.lit("mer")), {"subject": "subject", "body": "body"}, fulltext.postings)
    named = lambda q: sorted(r["doc_id"] for r in fulltext.holding(fields, q).collect())
    assert named("+subject:mer +body:re") == [2, 4] and named("body:mer") == [3] and named("other:mer") == []
    best = fulltext.best(found, "re la mer", 7, 2).collect()
    assert [r["doc_id"] for r in best] == [3, 2] and best[0]["score"] > best[1]["score"] and fulltext.best(found, "zzz", 7).count() == 0


def test_late_events_are_left_out(spark, tmp_path):
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double"
    batches = [[(1, datetime(2024, 1, 1), 1, "a", 0.0), (2, datetime(2024, 1, 10), 1, "a", 0.0)], [(3, datetime(2024, 1, 1), 1, "a", 0.0), (4, datetime(2024, 1, 20), 1, "b", 0.0)], [(5, datetime(2024, 2, 20), 1, "b", 0.0)]]
    for i, b in enumerate(batches):
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = windows.event_stream(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema)
    out = windows.drained(windows.windowed_counts(stream), "late_counts", "append", str(tmp_path / "state"))
    days = {(r["start"].date(), r["event_type"]): r["n"] for r in out.collect()}
    assert days[(date(2024, 1, 10), "a")] == 1 and (date(2024, 2, 20), "b") not in days


def test_streams_are_drained_to_files(spark, tmp_path):
    rows = [[(1, datetime(2024, 1, 1), 1, "a", 0.0), (2, datetime(2024, 1, 2), 1, "a", 0.0)], [(3, datetime(2024, 1, 3), 1, "a", 0.0), (4, datetime(2024, 1, 3), 2, "b", 1.0)]]
    for batch in rows:
        spark.createDataFrame(batch, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = windows.event_stream(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    copies = windows.drained(windows.first_copies(stream, ["user_id", "event_type", "value"]).select("user_id", "value"), "copies_to_files", "append")
    assert sorted(map(tuple, copies.collect())) == [(1, 0.0), (2, 1.0)]
    shared = spark.sparkContext.getCheckpointDir().rsplit("/", 1)[1]
    assert copies.inputFiles() and all(shared in f for f in copies.inputFiles())  # not in the driver's memory
    days = windows.drained(windows.windowed_counts(stream), "days_to_files", "complete")
    assert sorted((r["start"].day, r["n"]) for r in days.collect()) == [(1, 1), (2, 1), (3, 1), (3, 1)]
    seen = windows.drained(windows.running_counts(stream), "seen_to_files", "update", str(tmp_path / "state"))
    assert sorted((r["user_id"], r["n"]) for r in seen.collect()) == [(1, 2), (1, 3), (2, 1)]
    assert windows.drained(windows.running_counts(stream), "seen_again", "update", str(tmp_path / "state")).isEmpty()
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before


@pytest.mark.parametrize("spec", ["a", "b"])
def test_mail_directions(spark, spec):
    from mailquarry.operators.people import mailing_list_states

    addrs = spark.createDataFrame([(1, "from", "x"), (1, "to", "l"), (2, "from", "x"), (2, "to", "p"), (2, "to", "q"), (3, "from", "me"), (3, "to", "q")], "doc_id int, role string, contact string")
    directed = spark.createDataFrame([(1, False, False), (2, False, False), (3, True, False)], "doc_id int, sent boolean, to_me boolean")
    lists = spark.createDataFrame([("l",)], "contact string")
    out = {r["contact"]: r["state"] for r in mailing_list_states(addrs, directed, lists).collect()}
    assert out == {"x": 4, "l": 9, "p": 2, "q": 2, "me": 4}


def test_types_are_learned_and_labelled(spark):
    from mailquarry.operators import ner

    titles = [(f"University of {x}", "ORGANISATION") for x in ("Rome", "Oslo", "Lima")] + [(f"{x} Street", "PLACE") for x in ("High", "Rome", "Main")] + [("Oslo", "PLACE"), ("Lima", "PLACE")]
    gazette = spark.createDataFrame(titles, "title string, type string")
    table = {}
    for r in ner.type_table(ner.train(gazette)).collect():
        table.setdefault(r["token"], {})[r["type"]] = r["p"]
    assert table["university"] == {"ORGANISATION": 1.0} and table["street"] == {"PLACE": 1.0}
    assert [s[2] for s in ner.label_phrase("Park Street", table)] == ["PLACE"] and ner.label_phrase("Nothing Known", table) == []
    assert ner.label_phrase("oslo", table, {"oslo": "PLACE"}) == [(0, 4, "PLACE", 1.0)]
    docs = spark.createDataFrame([(1, "She left the University of Cairo for Main Street."), (2, None)], "doc_id int, body string")
    lines = [r["line"] for r in ner.span_lines(ner.recognised(docs, "body", ner.train(gazette))).collect()]
    assert any(x.startswith("University of Cairo;13;32;ORGANISATION") for x in lines) and any(x.startswith("Main Street;37;48;PLACE") for x in lines)


def test_bounded_group_algorithms():
    assert groups.supergroups([("a", "b"), ("a", "b", "c"), ("x",)]) == [("a", "b", "c"), ("x",)]
    assert groups.likeness_order([("a", "b"), ("x", "y"), ("b", "c"), ("y", "z")]) == [("a", "b"), ("b", "c"), ("x", "y"), ("y", "z")]


def test_group_joins_against_all_pairs(spark):
    import random

    pick = random.Random(4)
    sets = sorted({tuple(sorted(pick.sample("abcdefgh", pick.randint(1, 6)) + ["hub"] * pick.randint(0, 1))) for _ in range(120)})
    sets += [("lone",), tuple(f"m{i:02}" for i in range(40)), tuple(f"m{i:02}" for i in range(36))]
    found = spark.createDataFrame(list(enumerate(sets)), "group_id int, members array<string>").repartition(3)
    numbered = list(enumerate(map(set, sets)))
    inside = {(i, j) for i, a in numbered for j, b in numbered if a < b}
    assert sorted(map(tuple, groups.containments(found).collect())) == sorted(inside)
    assert {r["group_id"] for r in groups.without_subsets(found).collect()} == set(range(len(sets))) - {i for i, _ in inside}
    for least in (0.2, 0.5, 0.75, 1.0):
        like = [(i, j, round(len(a & b) / len(a | b), 6)) for i, a in numbered for j, b in numbered if i < j and len(a & b) / len(a | b) >= least]
        assert sorted(map(tuple, groups.similar_pairs(found, least).collect())) == like
    none = found.where("false")
    assert groups.containments(none).isEmpty() and groups.similar_pairs(none, 0.5).isEmpty()


def test_groups_do_not_meet_by_a_frequent_member_alone(spark):
    sets = [tuple(sorted({"hub", "club", f"a{i}", f"b{i}", f"c{i // 2}"} - ({"club"} if i % 3 else set()))) for i in range(300)]
    found = spark.createDataFrame([(i, list(s)) for i, s in enumerate(sets)], "group_id int, members array<string>")
    met = groups._meetings(groups._keyed(found), 0.5)
    rows = met.groupBy("key").count().agg({"count": "max"}).first()[0]
    assert rows <= 100  # those with both hub and club; all 300 have hub
    pairs = [(i, j) for i in range(300) for j in range(i + 1, 300) if len(set(sets[i]) & set(sets[j])) >= 0.4 * len(set(sets[i]) | set(sets[j]))]
    assert sorted((r["a"], r["b"]) for r in groups.similar_pairs(found, 0.4).collect()) == pairs


def test_nearest_names(spark):
    from mailquarry.operators.people import expanded_names, third_party

    long = spark.createDataFrame([("Ann Lee", 1, "t", "c"), ("Ann Ray", 2, "t", "c"), ("Ann Zoe", 3, "u", "d")], "name string, doc_id int, thread string, correspondent string")
    short = spark.createDataFrame([(2, "Ann", "t", "c"), (9, "ann", "u", "x"), (8, "Bob", "t", "c")], "doc_id int, name string, thread string, correspondent string")
    assert {(r["doc_id"], r["full"], r["score"]) for r in expanded_names(short, long).collect()} == {(2, "Ann Ray", 1.0), (9, "Ann Zoe", 0.9)}
    addrs = spark.createDataFrame([(1, "c1")], "doc_id int, contact string")
    book = spark.createDataFrame([("c1", "Ann Lee")], "contact string, name string")
    names = spark.createDataFrame([(1, "Lee"), (1, "Bob Ray")], "doc_id int, name string")
    assert [r["name"] for r in third_party(names, addrs, book).collect()] == ["Bob Ray"]


def test_file_sources(spark, tmp_path):
    from mailquarry.sources import files

    (tmp_path / "b").mkdir()
    (tmp_path / "b/x.txt").write_text("same")
    (tmp_path / "c").mkdir()
    (tmp_path / "c/x.txt").write_text("same")
    (tmp_path / "c/y.txt").write_text("other")
    assert {(r["filename"], r["size"], r["n"]) for r in files.blobs(spark, str(tmp_path)).collect()} == {("x.txt", 4, 2), ("y.txt", 5, 1)}
    (tmp_path / "p.sql").write_text("CREATE TABLE x;\nINSERT INTO `page` VALUES (1,0,'It\\'s',0),(2,4,'B',1);\n")
    assert [tuple(r) for r in files.sql_dump_tuples(spark, str(tmp_path / "p.sql")).orderBy("id").collect()] == [(1, 0, "It's"), (2, 4, "B")]
    (tmp_path / "a.csv").write_text("1,Ann & Bob & Cy,x\n2,Bob & Ann,y\n3,Solo,z\n")
    assert {tuple(r) for r in files.coauthors(spark, str(tmp_path / "a.csv")).collect()} == {("Ann", "Bob", 2), ("Ann", "Cy", 1), ("Bob", "Cy", 1)}
