"""Scalar functions, date notations, the stemmer and the file readers on documented examples."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from mailquarry.functions import dates
from mailquarry.functions import text as T
from mailquarry.functions.stem import stem
from mailquarry.operators import export, fulltext, people, timeline
from mailquarry.sources import files


def values(spark, f, given):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(given)], "i int, x string")
    return [r[0] for r in rows.orderBy("i").select(f(F.col("x"))).collect()]


@pytest.mark.parametrize(
    ("f", "cases"),
    [
        (T.clean_email, {" 'A@B.org\" ": "a@b.org", "''x@y.z": "x@y.z", None: None}),
        (T.org_of, {"a@abc.com": "abc", "b@b@b.com": "b", "c@cambridge.ac.uk": "cambridge", "d@hotmail.com": None, "e#live.com": None, "a@b": None}),
        (T.last_name, {"bill gates iii": "gates", "William H. Gates": "Gates", "Ian Vo": "Vo", "Ian V": None, "Ann": None}),
        (T.clean_person_name, {"'foo bar'": "foo bar", "foo  bar (at home)": "foo bar", "((": None, "single": None, "A@b.c": "a@b.c", "foo bar [dept]": "foo bar"}),
        (T.lookup_name, {"Smith, John Q.": "john smith", "John Smith": "john smith", "Single": "single", "J Q": "j q"}),
        (T.clean_subject, {"Re: Fwd: [list-x] hello  there": "hello there ", "RE:": "RE: ", "[a very long bracket mark here] x": "[a very long bracket mark here] x "}),
        (T.normalized_subject, {"Re: Hi": "hi", "re hi": "hi", "Re: ": "re: "}),
        (T.extension, {"a.tar.GZ": "gz", ".profile": None, "none": None, "x.": ""}),
        (T.url_domain, {"http://www.cs.example.org/a/b": "example.org", "https://x": "x"}),
        (T.acronym_of, {"Internal Revenue Service": "IRS"}),
        (T.canonical_term, {"Walking": "walk", "is": "is", "payments": "payment"}),
        (T.canonical_entity, {"White House, The": "house the white"}),
        (T.normalize_newlines, {"a\r\nb\rc": "a\nb\nc"}),
        (lambda c: T.array_text(T.names_from_email(c)), {"first.last@x.y": "First Last", "70451.2444@x": "", "a_b_c%d@x": "A B C", "one@x": ""}),
        (lambda c: T.array_text(T.paragraphs(c)), {"a \nb\n\n c": "a\nb\n|c\n"}),
        (lambda c: T.array_text(T.links_in(c)), {"see http://a.b/c. and <https://d.e>": "http://a.b/c|https://d.e"}),
        (lambda c: T.array_text(T.scripts_languages(c)), {"abc": "english", "नमस्ते": "hindi|marathi|english", "日本 です": "chinese|japanese|english"}),
        (lambda c: T.array_text(T.word_runs(c)), {"a b c": "a|a b|a b c|b|b c|c", "": ""}),
        (lambda c: T.whole_word(c, "an"), {"an apple": True, "banana": False}),
        (lambda c: T.redacted(c, F.array(F.lit("Jane Doe"))), {"Call Jane at 5": ".... Jane .. ."}),
        (lambda c: T.ellipsized(c, 6), {"abcdefghi": "abc...", "abc": "abc"}),
    ],
)
def test_scalars(spark, f, cases):
    assert values(spark, f, list(cases)) == list(cases.values())


def test_original_content(spark):
    cases = {
        "mine\n> quoted\nmore\nOn Monday, A wrote:\n> x": "mine\n . \nmore\n",
        "a\n_____________________\nFrom: b": "a\n",
        "a\nBegin forwarded message:\nb": "a\n",
        "a\n--- Original Message ---\nb": "a\n",
        "plain\ntext\n": "plain\ntext\n",
        "On a day\nhe wrote:\nx": "",
    }
    assert values(spark, T.original_content, list(cases)) == list(cases.values())


def test_stems():
    wanted = {"caresses": "caress", "ponies": "poni", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "sing": "sing", "hopping": "hop", "falling": "fall", "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat", "conditional": "condit", "vietnamization": "vietnam", "triplicate": "triplic", "hopefulness": "hope", "revival": "reviv", "adjustment": "adjust", "adoption": "adopt", "probate": "probat", "rate": "rate", "controlling": "control", "roll": "roll"}
    assert {w: stem(w) for w in wanted} == wanted


def test_dates():
    assert dates.sloppy_ranges("jan 10 - feb 5 2004") == [(date(2004, 1, 10), date(2004, 2, 5))]
    assert dates.sloppy_ranges("2004; mar 99") == [(date(2004, 1, 1), date(2004, 12, 31)), (date(1999, 3, 1), date(1999, 3, 31))]
    assert dates.sloppy_ranges("ju 2004") == [(date(2004, 1, 1), date(2004, 12, 31))]  # june or july: no month
    assert dates.interval("2004-20060723", date(2010, 1, 1)) == (date(2004, 1, 1), date(2006, 7, 23))
    assert dates.interval("200402", date(2010, 1, 1)) == (date(2004, 2, 1), date(2010, 1, 1))
    assert dates.day_bounds(2023, 2, 31) == (date(2023, 2, 28), date(2023, 2, 28))
    assert dates.month_starts(date(2003, 11, 5), date(2004, 1, 1)) == [date(2003, 11, 1), date(2003, 12, 1), date(2004, 1, 1)]


def test_cleaned_dates(spark):
    rows = spark.sql("select * from values ('f', 1, null, null), ('f', 2, timestamp_ntz'2001-01-01', null), ('f', 3, null, null), ('f', 4, null, timestamp_ntz'1950-01-01') as t(folder, msg_no, sent_date, received_date)")
    out = [(str(r["date"]), r["hacky_date"]) for r in timeline.cleaned_dates(rows).orderBy("msg_no").collect()]
    assert out == [("1960-01-01 00:00:00", True), ("2001-01-01 00:00:00", False), ("2001-01-01 00:00:00.001000", True), ("1950-01-01 00:00:00", True)]


def test_unified_contacts(spark):
    seen = spark.createDataFrame([("A@x.org", "Ann Lee"), ("ann@y.org", "Lee, Ann"), ("a@x.org", None), ("b@z.org", "Bob"), ("c@z.org", "Bob")], "email string, name string")
    found = sorted(r["emails"] for r in people.unified(seen).collect())
    assert found == [["a@x.org", "ann@y.org"], ["b@z.org"], ["c@z.org"]]
    book = spark.createDataFrame([("c1", "a@x.org", "Ann Lee"), ("c2", "b@z.org", "Bob Ray")], "contact string, email string, name string")
    asked = spark.createDataFrame([(1, "'A@X.org'", None), (2, "no@no", "Ray, Bob"), (3, "no@no", "No One")], "i int, email string, name string")
    assert [r["contact"] for r in people.lookup(asked, book).orderBy("i").collect()] == ["c1", "c2", None]


def test_match_kinds(spark):
    rows = spark.createDataFrame([("Lee", "Ann Lee"), ("IRS", "Internal Revenue Service"), ("Lee Ann", "Ann Lee"), ("x y", "z")], "a string, b string")
    assert [r[0] for r in rows.select(people.match_kind(F.col("a"), F.col("b"))).collect()] == ["CONTAINED", "ACRONYM", "CONTAINED_DIFFERENT_ORDER", None]


def test_lexicon(spark, tmp_path):
    path = tmp_path / "own.english.lex.txt"
    path.write_text("# comment\njoy: happy|glad\nall: {joy}|fine\njoy: merry\nbad line\na:b:c\n")
    rows = files.lexicon(spark, str(path)).collect()
    assert {(r["category"], r["term"]) for r in rows} == {("joy", "happy"), ("joy", "glad"), ("all", "{joy}"), ("all", "fine"), ("joy", "merry")}
    assert fulltext.expanded({"joy": "happy|glad", "all": "{joy}|fine"}) == {"all": ["happy", "glad", "fine"]}
    assert fulltext.query_parts('"a b"') == ["a b"] and fulltext.query_parts("a|b c") == ["a", "b c"] and fulltext.query_parts("new york the times") == ["new york", "york times"]


def test_text_formats(spark, tmp_path):
    (tmp_path / "book.txt").write_text("Me Myself\nme@x.org\n--\n[ML]\nlist@x.org\n-- \nAnn Lee\nA@Y.org\n")
    book = files.address_book(spark, str(tmp_path / "book.txt")).orderBy("block").collect()
    assert [(r["is_self"], r["is_list"], r["emails"]) for r in book] == [(True, False, ["me@x.org"]), (False, True, ["list@x.org"]), (False, False, ["a@y.org"])]
    (tmp_path / "map.txt").write_text("Big Apple\nNew York\nNYC\n--\nalone\n")
    assert {(r["entity"], r["name"]) for r in files.entity_map(spark, str(tmp_path / "map.txt")).collect()} == {("big apple", "Big Apple"), ("new york", "Big Apple"), ("nyc", "Big Apple")}
    (tmp_path / "names.txt").write_text("robert = bob = rob\n")
    assert {(r["variant"], r["canonical"]) for r in files.name_variants(spark, str(tmp_path / "names.txt")).collect()} == {("robert", "robert"), ("bob", "robert"), ("rob", "robert")}
    (tmp_path / "g.tsv").write_text("Paris (city)\tPlace\nX\tA\nX\tB\n")
    assert [(r["title"], r["type"]) for r in files.gazette(spark, str(tmp_path / "g.tsv")).collect()] == [("Paris", "Place")]
    (tmp_path / "t.nt").write_text('<http://id/fst1> <http://p#label> "One" .\n<http://id/fst2> <http://p#other> "Two" .\n')
    assert [(r["id"], r["label"]) for r in files.labels_of_triples(spark, str(tmp_path / "t.nt"), "http://p#label").collect()] == [("fst1", "One")]


def test_mbox(spark, tmp_path):
    (tmp_path / "a.mbox").write_text(
        "From x\nMessage-ID: <1>\nSubject: Hi\nFrom: Ann <A@x.org>\nTo: b@y.org, C <c@y.org>\nDate: Mon, 1 Jan 2001 10:00:00 +0000\nList-Post: <mailto:l@y.org>\n\nbody\n>From here\n"
        '\nFrom y\nSubject: Two\nMIME-Version: 1.0\nContent-Type: multipart/mixed; boundary="b"\n\n--b\nContent-Type: text/html\n\n<div>one</div>two<script>x</script>\n--b\nContent-Type: text/plain; name="f.txt"\nContent-Disposition: attachment; filename="f.txt"\n\nfile\n--b--\n'
    )
    a, b = files.mbox(spark, str(tmp_path / "a.mbox")).orderBy("msg_no").collect()
    assert (a["subject"], a["sender"][0]["email"], [t["email"] for t in a["to"]], a["list_post"]) == ("Hi", "a@x.org", ["b@y.org", "c@y.org"], ["l@y.org"])
    assert "From here" in a["body"] and a["sent_date"].year == 2001
    assert b["body"].startswith("one\ntwo") and "x" not in b["body"] and b["attachments"][0]["filename"] == "f.txt" and b["sent_date"] is None


def test_plausible(spark):
    dense = "\n".join(["x" * 70] * 60)
    assert values(spark, files.plausible, [dense, "a b\n" * 60, "short"]) == [False, True, True]


def test_exports(spark):
    rows = spark.createDataFrame([(1, "S\nx", "From a\nb")], "doc_id int, subject string, body string")
    assert export.mbox_text(rows).first()["value"] == "From -\nMessage-ID: 1\nSubject: S x\n\n>From a\nb\n"
    links = spark.createDataFrame([("HTTP://a",), ("http://a",)], "url string")
    assert export.links_json(links).first()["json"] == '{"url":"http://a","times":2}'


@pytest.mark.parametrize(
    ("f", "cases"),
    [
        (T.cleaned_message, {"a\n-- \nsig": "a", "a\nhe wrote:\nb": "a", "plain": "plain"}),
        (T.escaped_html, {'<a & "b">': "&lt;a &amp; &quot;b&quot;&gt;"}),
        (T.unescaped_html, {"&lt;a &amp; b&gt;": "<a & b>"}),
        (lambda c: T.blanked_word(c, "Ann"), {"Ann met Anna": "___ met Anna"}),
        (T.without_titles, {"Dr. Mrs Ann Lee": "Ann Lee", "Drake": "Drake"}),
        (T.comma_flipped, {"Lee, Ann": "Ann Lee", "Ann Lee": "Ann Lee"}),
        (T.title_cased, {"bank of america": "Bank of America"}),
        (lambda c: T.is_acronym_of(F.lit("BA"), c), {"Bank of America": True, "Big": False}),
        (lambda c: T.array_text(T.sentences(c)), {"One. Two! three.\nFour": "One.|Two! three.|Four"}),
    ],
)
def test_more_scalars(spark, f, cases):
    assert values(spark, f, list(cases)) == list(cases.values())


def test_boosts(spark):
    from mailquarry.operators.curation import boosts

    log = spark.createDataFrame([("a", 1, "boost"), ("b", 1, "boost"), ("b", 2, "cancel"), ("c", 1, "cancel"), ("c", 2, "boost")], "term string, at int, kind string")
    assert {(r["term"], r["boost"]) for r in boosts(log).collect()} == {("a", 2.0), ("b", 0.0), ("c", 2.0)}
