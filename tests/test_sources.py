"""Readers and writers."""

import json

from pyspark.sql import functions as F

from corpusworks import fixed
from corpusworks.operators import extract as X
from corpusworks.operators import rendering as R
from corpusworks.operators import routing as J
from corpusworks.sources import catalogs, files, pairs


def test_read_pairs_edge_cases(spark, tmp_path):
    file = tmp_path / "train.jsonl"
    good = {"system": "s", "prompt": "é", "completion": "c", "metadata": {"category": "A", "adapter": "go_gin", "construct": "QUERY", "idx": 3}}
    file.write_text("\n".join([json.dumps(good, ensure_ascii=False), "", "not json", json.dumps({"prompt": "only"}), "   "]) + "\n", encoding="utf-8")
    rows = pairs.read_pairs(spark, str(file)).collect()
    assert [(r.system, r.prompt) for r in rows] == [("s", "é"), (None, "only")] and rows[0].metadata.idx == 3
    assert [r.line for r in pairs.rejected_lines(spark, str(file)).collect()] == ["not json"]
    assert pairs.read_pairs(spark, str(tmp_path / "none.jsonl")).count() == 0


def test_fields_of_other_types_keep_their_line(spark, tmp_path):
    file = tmp_path / "train.jsonl"
    lines = [{"prompt": "a", "metadata": {"idx": "7", "adapter": "x"}}, {"prompt": "b", "metadata": {"idx": 3.5}}, {"prompt": "c", "metadata": "x"}, {"prompt": "d", "metadata": {"idx": 4}}]
    file.write_text("\n".join(map(json.dumps, lines)) + "\n[1]\n{broken\n")
    rows = {r.prompt: r.metadata for r in pairs.read_pairs(spark, str(file)).collect()}
    assert set(rows) == set("abcd") and rows["d"].idx == 4 and (rows["b"] is None or rows["b"].idx is None) and rows["c"] is None
    assert sorted(r.line for r in pairs.rejected_lines(spark, str(file)).collect()) == ["[1]", "{broken"]


def test_counts_of_written_pairs(spark, tmp_path):
    pair = F.struct(F.lit("C").alias("category"), F.col("a").alias("adapter"))
    df = spark.createDataFrame([("go_gin", "train", str(n)) for n in range(50)] + [("go_gin", "val", "v"), ("sql_mysql", "train", "s")], "a string, split string, prompt string")
    rows = df.select(F.lit("s").alias("system"), "prompt", F.lit("c").alias("completion"), pair.alias("metadata"), "split")
    pairs.write_pairs(rows.repartition(20), str(tmp_path / "out"), files=4)
    pairs.append_corrections(rows.where("split = 'val'"), str(tmp_path / "out"))
    adapters = spark.createDataFrame([("go_gin",), ("sql_mysql",)], "adapter string")
    got = {(r.adapter, r.kind): r.rows for r in pairs.file_counts(spark, f"{tmp_path}/out/*/*/*.json", adapters).collect()}
    assert got == {("go_gin", "train"): 50, ("go_gin", "validation"): 1, ("go_gin", "corrections"): 1, ("sql_mysql", "train"): 1, ("sql_mysql", "validation"): 0, ("sql_mysql", "corrections"): 0}
    assert len(list((tmp_path / "out" / "adapter=go_gin" / "split=train").glob("*.json"))) <= 4


def test_write_and_append(spark, tmp_path):
    meta = F.struct(F.lit("C").alias("category"), F.lit("go_gin").alias("adapter"), F.lit("LOOP").alias("construct"), F.lit(1).alias("idx"))
    df = spark.createDataFrame([("s", "π", "c")], "system string, prompt string, completion string").withColumn("metadata", meta)
    path = str(tmp_path / "out")
    pairs.write_pairs(df, path)
    assert pairs.read_pairs(spark, path).collect()[0].prompt == "π"
    log = str(tmp_path / "corrections")
    for _ in range(3):
        pairs.append_corrections(df, log)
    assert pairs.read_pairs(spark, log).count() == 3


def test_packed_corrections_are_read_beside_plain_ones(spark, tmp_path):
    """Packed lines count like plain ones in batch, in file counts and in a stream, and take less room."""
    from corpusworks.streaming import events

    meta = F.struct(F.lit("C").alias("category"), F.lit("go_gin").alias("adapter"))
    df = spark.createDataFrame([(f"{n} " + "the same text " * 50,) for n in range(200)], "prompt string")
    df = df.select(F.lit("s").alias("system"), "prompt", F.col("prompt").alias("completion"), meta.alias("metadata"))
    log = str(tmp_path / "corrections")
    pairs.append_corrections(df, log)
    pairs.append_corrections(df, log, compression="gzip")
    size = {end: sum(p.stat().st_size for p in (tmp_path / "corrections").rglob(f"part-*{end}")) for end in (".json", ".json.gz")}
    assert 0 < size[".json.gz"] < size[".json"] / 5
    got = pairs.read_pairs(spark, log).groupBy("prompt", "completion").count().collect()
    assert len(got) == 200 and all(r["count"] == 2 and r.prompt == r.completion for r in got)
    counts = pairs.file_counts(spark, f"{log}/*/*/*.json*", spark.createDataFrame([("go_gin",)], "adapter string"))
    assert {r.kind: r.rows for r in counts.collect()}["corrections"] == 400
    query = events.stream_corrections(spark, log).writeStream.format("memory").queryName("packed").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("packed").count() == 400


def test_file_counts(spark, tmp_path):
    for name, n in (("go_gin/train", 3), ("go_gin/val", 2), ("sql_mysql/validation", 1)):
        file = tmp_path / f"{name}.jsonl"
        file.parent.mkdir(exist_ok=True)
        file.write_text("{}\n" * n + "\n")
    adapters = spark.createDataFrame([("go_gin",), ("sql_mysql",), ("rust_axum",)], "adapter string")
    rows = {(r.adapter, r.kind): r.rows for r in pairs.file_counts(spark, f"{tmp_path}/*/*.jsonl", adapters).collect()}
    assert len(rows) == 9 and rows["go_gin", "train"] == 3 and rows["go_gin", "validation"] == 2
    assert rows["sql_mysql", "validation"] == 1 and rows["rust_axum", "train"] == 0


def test_catalog(spark, tmp_path):
    file = tmp_path / "adapters.json"
    file.write_text(json.dumps({
        "base_model": "b", "adapter_repo": "org/repo", "phases": {"0": {"adapters": ["x", "y"], "description": "first"}},
        "adapters": {"x": {"pairs": 5, "phase": 0, "threshold": 0.95}, "y": {}}}, indent=1))
    rows = {r.profile: r for r in catalogs.read_adapter_catalog(spark, str(file)).collect()}
    assert rows["x"].adapter_id == "org/repo/tree/main/x" and rows["x"].pairs == 5 and rows["x"].base_model == "b"
    assert (rows["y"].phase, rows["y"].threshold, rows["y"].pairs) == (-1, 0.90, 0)
    assert sorted((r.phase, r.profile) for r in catalogs.read_phase_catalog(spark, str(file)).collect()) == [(0, "x"), (0, "y")]
    assert catalogs.read_adapter_catalog(spark, str(tmp_path / "none.json")).count() == 0


def test_route(spark):
    catalog = J.default_catalog(spark)
    assert catalog.count() == 24
    assert {r.phase: r.n for r in catalog.groupBy("phase").agg(F.count("*").alias("n")).collect()} == {0: 2, 1: 4, 2: 7, 3: 6, 4: 3, 5: 2}
    df = spark.createDataFrame([("go_gin",), ("Go_Gin",), ("",), (None,)], "profile string")
    routed, rejected = J.route(df, catalog)
    assert [r.adapter_id for r in routed.collect()] == ["go_gin"]
    errors = {r.profile: r.error for r in rejected.collect()}
    assert errors[""] == errors[None] == "profile must not be empty"
    assert errors["Go_Gin"].startswith("Unknown profile 'Go_Gin'. Known profiles (24): cpp_modern, csharp_dotnet")
    assert J.list_profiles(catalog, 99).count() == 0
    phases = J.adapters_by_phase(catalog).collect()
    assert [p.phase for p in phases] == list(range(6)) and phases[0].profiles[0].threshold_percent == 90


def test_versions(spark, tmp_path):
    root = str(tmp_path / "t")
    assert files.latest_version(spark, root) is None
    files.write_version(spark.range(3), root, 1)
    files.write_version(files.read_version(spark, root).where("id > 0"), root, 2)
    assert files.latest_version(spark, root) == 2 and files.read_version(spark, root).count() == 2


SOURCE = '''MODULE auth [id=m001]
TARGET    "src/auth.py"
PROFILE   python_fastapi
NAMESPACE "app.auth"
REQUIRES  m002  m003
VERSION   "1.2.0"

FUNCTION login [ id = f001 ]
  INTENT       "check a password"
  PRECONDITION email.length > 0
  PRECONDITION password.length >= 8
  POSTCONDITION result.token IS NOT NULL
  READS        users_table
  MUTATES      sessions_table
  OBSERVABLE
  CONFIDENCE   0.95
  TIMEOUT      30s

  user = QUERY users_table WHERE email == email LIMIT 1
  IF user IS NULL THEN FAIL AuthError("user_not_found")
  token = make_token(user.id)
  SEQUENCE
    CACHE SET key = token TTL 1h
  END SEQUENCE
  RETURN SessionToken(token: token)
END FUNCTION login [id=f001]

TYPE Token [id=t001]
  token     : String(40) NOT NULL
  FIELD seen: DateTime DEFAULT NOW()
  extra : Map<String,Int>
  CONSTRAINT seen > token
END TYPE Token [id=t001]

PATCH FUNCTION login [id=f001]
  INTENT "limit"
  INSERT PRECONDITION rate_ok
END PATCH FUNCTION login [id=f001]
'''


def test_source_text(spark, tmp_path):
    (tmp_path / "a.block").write_text(SOURCE)
    sources = files.read_sources(spark, f"{tmp_path}/*.block")
    module = X.module_fields(sources).collect()[0]
    assert (module.module_id, module["name"], module.profile, module.requires, module.version) == ("m001", "auth", "python_fastapi", ["m002", "m003"], "1.2.0")
    fields = {r.kind: r for r in X.block_fields(X.blocks_of(sources)).collect()}
    login = fields["FUNCTION"]
    assert login.id == "f001" and login.intent == "check a password" and len(login.preconditions) == 2 and len(login.postconditions) == 1
    assert login.reads == ["users_table"] and login.mutates == ["sessions_table"] and login.observable and login.confidence == 0.95 and login.timeout == "30s"
    assert fields["PATCH"].confidence == 1.0 and fields["PATCH"].preconditions == []
    types = {r.field: r for r in X.type_fields(X.blocks_of(sources)).collect()}
    assert types["token"].type == "String(40)" and types["token"].not_null and types["seen"].default_value == "NOW()"
    assert types["extra"].type == "Map<String,Int>" and types[None].constraint == "seen > token"
    uses = {r.construct: r.uses for r in X.construct_usage(X.blocks_of(sources)).where("kind = 'FUNCTION'").collect()}
    assert uses == {"QUERY": 1, "IF": 1, "FAIL": 1, "ASSIGN": 1, "SEQUENCE": 1, "CACHE SET": 1, "RETURN": 1}


def test_views_of_long_texts_are_spread_by_rows(spark, tmp_path, monkeypatch):
    """A small file of short rows becomes many tasks where the view makes long texts of them; rows stay the same."""
    from corpusworks.plans import inputs

    columns = "id as p_partkey, 'p' as p_name, 'Brand#1' as p_brand, 'LARGE' as p_type, cast(id % 50 as int) as p_size"
    spark.range(300).selectExpr(*columns.split(", ")).coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    plain = {name: inputs.view(spark, str(tmp_path), name) for name in ("sources", "manifests")}
    monkeypatch.setattr(inputs, "SPREAD", 50)
    for name, rows in plain.items():
        dealt = inputs.view(spark, str(tmp_path), name)
        assert dealt.rdd.getNumPartitions() == 6 and sorted(dealt.collect()) == sorted(rows.collect())


def test_corrections(spark):
    failed = "array(named_struct('name', 'T7', 'message', 'TODO', 'detail', 'd'), named_struct('name', 'T2', 'message', 'none', 'detail', ''))"
    df = spark.sql(f"select 'go_gin' adapter, 'go' language, 'f1' block_id, 'n' block_name, ' BLOCK ' intl_block, ' code ' compiled_code, 'fixed' corrected, 2 retry_count, {failed} failed")
    pair = R.render_correction(df, F.expr("timestamp_ntz'2024-02-01 10:00:00'")).collect()[0]
    assert pair.prompt == "BLOCK\n\n# PREVIOUS ATTEMPT (failed):\ncode\n\n# FAILING CHECKS: T7: TODO; T2: none"
    assert pair.metadata.failing_checks == ["T7", "T2"] and pair.metadata.timestamp == "2024-02-01T10:00:00.000000+00:00"
    text = R.render_escalation(df).collect()[0].package_text
    assert "[T7] TODO — d\n  [T2] none —\n====" in text and "RETRY COUNT:  2" in text
    empty = df.withColumn("failed", F.expr(f"filter({failed}, x -> false)"))
    assert "(none listed)" in R.render_escalation(empty).collect()[0].package_text


def test_line_patches(spark):
    docs = spark.createDataFrame([(1, "a\nb\nc"), (2, "x")], "d int, text string")
    ops = [(1, 1, "insert", "after", "b", "b2"), (1, 2, "insert", "before", "b", "b0"), (1, 3, "replace", "at", "c", "C"),
           (1, 4, "remove", "at", "a", None), (1, 5, "insert", "after", "zzz", "never"), (1, 6, "insert", "after", "b", "b3")]
    patches = spark.createDataFrame(ops, "d int, seq int, action string, position string, anchor string, body string")
    rows = {r.d: (r.patched, r.applied) for r in X.apply_line_patches(docs, patches, "d", "text").collect()}
    assert rows == {1: ("b0\nb\nb2\nb3\nC", 5), 2: ("x", 0)}


def test_constants():
    assert len(fixed.PROFILES) == 24 and sum(p[3] for p in fixed.PROFILES) == 40800 and len(fixed.CONSTRUCTS) == 22
    assert len(fixed.STATEMENTS) == 24
