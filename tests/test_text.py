"""Scripts, responses, names and captions on small rows."""

import pytest
from pyspark.sql import functions as F

from loomgrid.functions import text as T
from loomgrid.operators import scripts as S
from loomgrid.operators import templates as M


def column(spark, value, make):
    return spark.createDataFrame([(value,)], "v string").select(make(F.col("v")).alias("r")).first().r


def test_lines_count_blank_ones_and_read_time_marks(spark):
    raw = "\n  00:00 - Introduction\n\n[1:30] second\n1:23:45 - third\nplain\n2:00\n"
    lines = S.line_timestamps(S.script_lines(spark.createDataFrame([(1, raw)], "script_id long, raw string"))).orderBy("line_index").collect()
    assert [(r.line_index, r.ts, r.text) for r in lines] == [(0, "00:00", "Introduction"), (2, "1:30", "second"), (3, "1:23:45", "third"), (4, None, "plain")]


def test_density(spark):
    for density, n, kept in [("sparse", 30, 3), ("sparse", 5, 1), ("moderate", 25, 5), ("moderate", 5, 2), ("dense", 20, 10), ("dense", 4, 3)]:
        moments = spark.range(30).select(F.lit(1).alias("script_id"), F.col("id").alias("pos"), (F.col("id") / 30).alias("confidence"))
        out = S.density_cap(moments, spark.createDataFrame([(1, n)], "script_id int, n_lines int"), density).orderBy("place").collect()
        assert len(out) == kept and out[0].pos == 29


def test_json_recovery(spark):
    for value, found in [('{"a": 1}', True), ("[1, 2]", True), ('```json\n{"a": 1}\n```', True), ("```\n[1]\n```", True), ('so {"a": 1} it is', True), ("list: [1, 2].", True), ("plain prose", False), ("", False), ("{broken", False)]:
        assert (column(spark, value, lambda c: T.json_response(c).isNotNull())) is found, value


def test_critiques_coerce(spark):
    rows = [(1, '{"surprise_score": 4, "relevance_score": "5", "timing_score": 4.9, "freshness_score": 3}'), (2, "[1]"), (3, '{"surprise_score": "x"}'), (4, '{"passes_layer_test": "false", "alternative": {"template_name": "T"}}'), (5, '{"passes_layer_test": false, "alternative": {}}')]
    out = {r.suggestion_id: r for r in S.critique_coerce(spark.createDataFrame(rows, "suggestion_id int, t string").select("suggestion_id", F.parse_json("t").alias("response"))).collect()}
    assert (out[1].overall, out[1].passes) == (4.0, True)
    assert (out[2].overall, out[2].passes, out[3].overall) == (3.0, True, 3.0)
    assert (out[4].passes, out[4].alternative) == (True, "T")
    assert (out[5].passes, out[5].alternative) == (False, None)


def test_best_of_each_moment(spark):
    rows = [(1, 0, 0, True, 4.0, False), (1, 1, 1, False, 1.0, False), (1, 2, 2, True, 3.0, False), (1, 2, 3, True, 5.0, False), (1, 3, 4, False, 2.0, True), (1, 4, 5, False, 4.5, False)]
    out = S.best_per_moment(spark.createDataFrame(rows, "script_id int, line_index int, pos int, passes boolean, overall double, has_alt boolean")).collect()
    assert {(r.line_index, r.pos, r.is_alternative, r.score) for r in out} == {(0, 0, False, 4.0), (2, 3, False, 5.0), (3, 4, True, 3.0), (4, 5, False, 4.5)}


def test_slug_and_display(spark):
    assert column(spark, "It's the Same Picture!", T.slugify) == "its_the_same_picture"
    assert column(spark, "Hi", lambda c: T.display_secs(F.create_map(F.lit("k"), c))) == 2.0
    assert column(spark, "x" * 100, lambda c: T.display_secs(F.create_map(F.lit("k"), c))) == 5.0


def test_names_match_in_tiers(spark):
    templates = spark.createDataFrame([(0, "Distracted Boyfriend"), (1, "Drake"), (2, "Same Picture")], "tpl_pos long, name string")
    names = spark.createDataFrame([(1, "drake"), (2, "the drake meme"), (3, "picture boyfriend distracted"), (4, "nothing")], "q_id long, q string")
    out = {r.q_id: (r.tpl_pos, r.tier) for r in M.tpl_fuzzy(names, templates).collect()}
    assert out == {1: (1, 1), 2: (1, 2), 3: (0, 3), 4: (None, None)}


def test_wrapping(spark):
    assert column(spark, "one two three extraordinarily", lambda c: M.wrap(c, F.lit(8))) == ["one two", "three", "extraord", "inarily"]


def test_inference_errors_stay_in_their_row(spark):
    def score(prompt):
        if prompt == "bad":
            raise ValueError("no")
        return prompt.upper()

    out = {r.k: (r.response, r.error) for r in S.batch_infer(spark.createDataFrame([(1, "ok"), (2, "bad")], "k long, prompt string"), "k", score).collect()}
    assert out == {1: ("OK", None), 2: (None, "no")}


def test_sources_that_are_not_there(spark, tmp_path):
    from loomgrid.sources import tables as S

    assert S.read_templates(spark, f"{tmp_path}/none.json").count() == 0
    assert S.read_elements(spark, f"{tmp_path}/none.json").count() == 0
    (tmp_path / "roads.json").write_text('{"elements": [{"type": "way", "id": 1}]}')
    assert S.read_elements(spark, f"{tmp_path}/roads.json").first().id == 1
    import gzip

    (tmp_path / "roads.json.gz").write_bytes(gzip.compress(b'{"elements": [{"type": "way", "id": 2}]}'))
    assert [r.id for r in S.read_elements(spark, f"{tmp_path}/roads.json").collect()] == [2]


def test_blank_scripts(spark, tmp_path):
    from loomgrid.sources import tables as S

    (tmp_path / "a.txt").write_text("0:01 - hello")
    (tmp_path / "b.txt").write_text(" \n\t")
    assert [r.raw for r in S.read_scripts(spark, f"{tmp_path}/*.txt", blank="drop").collect()] == ["0:01 - hello"]
    with pytest.raises(Exception, match="empty"):
        S.read_scripts(spark, f"{tmp_path}/*.txt").collect()


def test_many_scripts_lie_in_few_folders(spark, tmp_path):
    """A file a script, but neither a folder nor, for two scripts of one id, a shared file; the same rows in a store that Spark alone knows."""
    from loomgrid.sources import tables as S

    scripts = spark.range(2500).select(F.expr("id % 2400").alias("script_id"), F.expr("'é ' || id || '\\n'").alias("value"))
    want = sorted(str(i % 2400) + f"é {i}\n\n" for i in range(2500))
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.scripts.link./at", f"file:{tmp_path}")
    for path in (f"{tmp_path}/plain", f"file://{tmp_path}/scheme", "viewfs://scripts/at/other"):
        few = scripts if "viewfs" not in path else scripts.where("script_id % 60 = 0")
        S.write_scripts(few, path, per_folder=500)
        read = S.read_scripts(spark, f"{path}/*").select(F.regexp_extract("script_id", r"script_id=(\d+)", 1).alias("i"), "raw").collect()
        assert sorted(r.i + r.raw for r in read) == (want if few is scripts else sorted(x for x in want if int(x.split("é")[0]) % 60 == 0))
    assert len(list((tmp_path / "plain").iterdir())) == 5 and sum(len(list(d.iterdir())) for d in (tmp_path / "plain").iterdir()) == 2500
    with pytest.raises(FileExistsError):
        S.write_scripts(scripts, f"{tmp_path}/plain")


def test_scripts_of_one_supplier_key_stay_apart(spark, tmp_path):
    """Equal keys are two scripts, as in the SQL; a table without rows has none."""
    import __spark_entry__ as entry

    rows = spark.createDataFrame([(7, "A", 1), (7, "B", 2), (7, "B", 2), (8, "C", 3)], "s_suppkey long, s_name string, s_nationkey int")
    rows.write.parquet(f"{tmp_path}/supplier.parquet")
    got = entry.queries()["src_scripts"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == [(7, "0:07 - A\nnation 1"), (7, "0:07 - B\nnation 2"), (7, "0:07 - B\nnation 2"), (8, "0:08 - C\nnation 3")]
    rows.limit(0).write.parquet(f"{tmp_path}/none/supplier.parquet")
    assert entry.queries()["src_scripts"](spark, f"{tmp_path}/none").collect() == []


def test_manifests(spark):
    from loomgrid.operators import scripts as P

    moments = spark.createDataFrame([(1, 0), (1, 4), (2, 1)], "script_id long, line_index long")
    said = spark.createDataFrame([(1, 10), (1, 11)], "script_id long, pos long")
    outputs = spark.createDataFrame([(1, 11, "b"), (1, 10, "a")], "script_id long, first_pos long, file_name string")
    out = {r.script_id: r for r in P.manifests({"density": "light"}, moments, said, outputs).collect()}
    assert (out[1].total_moments_detected, out[1].total_suggestions_generated, out[1].total_memes_output) == (2, 2, 2)
    assert [m.file_name for m in out[1].memes] == ["a", "b"] and out[1].config == {"density": "light"}
    assert (out[2].total_moments_detected, out[2].total_memes_output, out[2].memes) == (1, 0, [])


def test_names_that_hold_each_other(spark):
    from loomgrid.operators import templates as M

    names = ["", "a", "ab", "big cat", "the big cat sat", "dog", "do", "zz zz", "CAT"]
    t = spark.createDataFrame([(k, n) for k, n in enumerate(["cat", "a big cat sat down", "Dog", "do", "xyz", "x"])], "tpl_pos long, name string")
    out = {r.q: (r.tpl_pos, r.tier) for r in M.tpl_fuzzy(spark.createDataFrame([(k, n) for k, n in enumerate(names)], "q_id long, q string"), t).join(spark.createDataFrame([(k, n) for k, n in enumerate(names)], "q_id long, q string"), "q_id").collect()}
    listed = [(k, n.lower()) for k, n in enumerate(["cat", "a big cat sat down", "Dog", "do", "xyz", "x"])]
    for q in names:
        low = q.lower()
        exact = [k for k, n in listed if n == low]
        held = [k for k, n in listed if n in low or low in n]
        shared = [(-len(set(low.split()) & set(n.split())), k) for k, n in listed if set(low.split()) & set(n.split())]
        want = (max(exact), 1) if exact else (min(held), 2) if held else (min(shared)[1], 3) if shared else (None, None)
        assert out[q] == want, q


def test_names_probe_their_rarest_piece(spark):
    """Half of all names begin alike, and some hold characters of one, two and four bytes; against all pairs."""
    import random

    rnd = random.Random(31)
    word = lambda: "".join(rnd.choice("abcdeé𝒳 ") for _ in range(rnd.randint(0, 6)))
    long = [("the great " if k % 2 else "") + word() + rnd.choice(["", " meme"]) for k in range(400)] + [None, "", "ab"]
    short = [word() for _ in range(300)] + ["the " + word() for _ in range(150)] + ["the great", "the great", "the", "th", "t", "", None, "zzz", "the zzz"]
    s = spark.createDataFrame(list(enumerate(short)), "s_id int, a string")
    t = spark.createDataFrame(list(enumerate(long)), "l_id int, b string")
    want = sorted((i, j) for i, x in enumerate(short) for j, y in enumerate(long) if x and y is not None and x in y)
    for frequent in (1000, 3):
        M.FREQUENT, kept = frequent, M.FREQUENT
        try:
            assert sorted((r.s_id, r.l_id) for r in M.held_in(s, t, "a", "b").collect()) == want
            keys = M.rarest_pieces(s, t, "a", "b").collect()
        finally:
            M.FREQUENT = kept
        for r in keys:  # the piece is the rarest of the text's own
            pieces = {r.a[k : k + 3] for k in range(max(1, len(r.a) - 2))}
            assert r._g in pieces and r._df == min(sum(p in (y or "") for y in long) for p in pieces)
    assert any(r.a.startswith("the ") and r._df < 5 for r in keys) and len(want) > 500


def test_names_against_an_empty_catalogue(spark):
    none = spark.createDataFrame([], "l_id int, b string")
    some = spark.createDataFrame([(1, "abc")], "s_id int, a string")
    assert M.held_in(some, none, "a", "b").count() == 0 and M.held_in(none, some, "b", "a").count() == 0
