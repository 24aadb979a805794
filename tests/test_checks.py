"""The validator's cases as rows, and slow Python models of the checks on generated texts."""

import random
import re

import pytest
from pyspark.sql import functions as F

from corpusworks import fixed
from corpusworks.functions import checks as C
from corpusworks.functions import text as T
from corpusworks.operators import validate as V

OPEN = "# ═══ INTL:BEGIN [id=f001] login ═══\n"
CLOSE = "\n# ═══ INTL:END   [id=f001] login ═══\n"
GOOD = (
    OPEN
    + "import logging\nlogger = logging.getLogger('auth')\n\n"
    + "def login(email, password) -> SessionToken:\n    if len(email) == 0 or len(password) < 8:\n"
    + "        raise ValueError('bad input')\n    logger.info('try')\n    result = db.execute(email)\n    return SessionToken(result)"
    + CLOSE
)
SCHEMA = (
    "case string, profile string, compiled_code string, preconditions array<string>, postconditions array<string>, "
    "mutates array<string>, emits array<string>, observable boolean, return_type string"
)


def row(case, code=GOOD, profile="python_fastapi", pre=(), post=(), mutates=(), emits=(), observable=False, return_type=None):
    return (case, profile, code, list(pre), list(post), list(mutates), list(emits), observable, return_type)


CASES = {
    # case: (row, failing checks)
    "all good": (
        row("", pre=["email.length > 0", "password.length >= 8"], post=["result IS NOT NULL"], mutates=["sessions_table"],
            observable=True, return_type="SessionToken"), [],
    ),
    "python syntax": (row("", OPEN + "def bad(\n    return 1" + CLOSE), ["T1-Syntax"]),
    "sql": (row("", OPEN.replace("#", "--") + "select id from users" + CLOSE.replace("#", "--"), "sql_postgres"), []),
    "html": (row("", "<!-- INTL:BEGIN [id=f001] --><form>x</form><!-- INTL:END [id=f001] -->", "html_jinja2"), []),
    "css": (row("", "/* INTL:BEGIN [id=f001] */ .btn-x { color: red } /* INTL:END [id=f001] */", "css_tailwind"), []),
    "empty sql": (row("", "", "sql_postgres"), ["T1-Syntax", "T2-Sentinel"]),
    "plain html": (row("", "INTL:BEGIN [id=f001] text INTL:END [id=f001]", "html_blade"), ["T1-Syntax"]),
    "css without rule": (row("", "INTL:BEGIN [id=f001] text INTL:END [id=f001]", "css_tailwind"), ["T1-Syntax"]),
    "balanced": (row("", OPEN + "function f() { return [1, (2)]; }" + CLOSE, "typescript_express"), []),
    "unbalanced": (row("", OPEN + "function f() { { return 1; }" + CLOSE, "typescript_express"), ["T1-Syntax"]),
    "crossed": (row("", OPEN + "f([)]" + CLOSE, "go_gin"), ["T1-Syntax"]),
    "marker typo": (row("", GOOD.replace("INTL:BEGIN", "INTL:BGIN")), ["T2-Sentinel"]),
    "wrong id": (row("", GOOD.replace("f001", "f999")), ["T2-Sentinel"]),
    "no marker": (row("", "def f():\n    return 1\n"), ["T2-Sentinel"]),
    "lower case marker": (row("", GOOD.replace("INTL:BEGIN", "intl:begin")), []),
    "unknown precondition": (row("", pre=["nonexistent_xyz_field > 0"]), ["T3-Preconditions"]),
    "one known of two": (row("", pre=["email.length > 0", "nonexistent_xyz_field > 0"]), ["T3-Preconditions"]),
    "part of a word": (row("", pre=["emai > 0"]), ["T3-Preconditions"]),
    "no name": (row("", pre=["1 > 0"], post=["1 > 0"]), ["T3-Preconditions"]),
    "only stop words": (row("", pre=["IS NOT NULL"], post=["NOW IS NULL"]), ["T3-Preconditions"]),
    "no return": (row("", OPEN + "print('hello')" + CLOSE, post=["x IS NOT NULL"]), ["T4-Postconditions"]),
    "unknown postcondition": (row("", post=["absent_thing == 1"]), ["T4-Postconditions"]),
    "no write": (row("", OPEN + "def fn(): return 1" + CLOSE, mutates=["users"]), ["T5-SideEffects"]),
    "no log": (row("", OPEN + "def fn(): return 1" + CLOSE, observable=True), ["T5-SideEffects"]),
    "no emit": (row("", OPEN + "def fn(): return 1" + CLOSE, emits=["done"]), ["T5-SideEffects"]),
    "emit": (row("", OPEN + "def fn(): publish('done')" + CLOSE, emits=["done"]), []),
    "type absent": (row("", return_type="NonExistentType"), ["T6-Types"]),
    "generic type": (row("", OPEN + "x: List[str] = y" + CLOSE, return_type="List[str]"), ["T6-Types"]),
    "empty type": (row("", return_type=""), []),
    "todo": (row("", OPEN + "# todo: later\nx = 1" + CLOSE), ["T7-NoPlaceholders"]),
    "fixme": (row("", OPEN + "# FIXME\nx = 1" + CLOSE), ["T7-NoPlaceholders"]),
    "todos is no todo": (row("", OPEN + "todos = 1" + CLOSE), []),
    "bare pass": (row("", OPEN + "def f():\n    pass" + CLOSE), ["T7-NoPlaceholders"]),
    "pass with more": (row("", OPEN + "pass_on = 1" + CLOSE), []),
    "unimplemented": (row("", OPEN + "fn f() { unimplemented!() }" + CLOSE, "rust_axum"), ["T7-NoPlaceholders"]),
    "throw": (row("", OPEN + 'f() { throw new Error("not implemented") }' + CLOSE, "typescript_nextjs"), ["T7-NoPlaceholders"]),
    "no code at all": (row("", None, "go_gin"), ["T2-Sentinel"]),
    "no profile": (row("", OPEN + "x = [1" + CLOSE, None), ["T1-Syntax"]),
    "html attribute": (row("", "INTL:BEGIN [id=f001]<input placeholder='x'>INTL:END [id=f001]", "html_blade"), ["T7-NoPlaceholders"]),
}


@pytest.fixture(scope="module")
def validated(spark):
    rows = [(case, *spec[0][1:]) for case, spec in CASES.items()]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("block_id", F.lit("f001"))
    df = df.withColumn("intl_block", F.lit("FUNCTION login [id=f001]"))
    return {r["case"]: r for r in V.escalation_package(V.with_summary(V.validate(df))).collect()}


@pytest.mark.parametrize("case", list(CASES))
def test_case(validated, case):
    r = validated[case]
    assert [c["name"] for c in r.checks] == fixed.CHECK_NAMES
    assert [c["name"] for c in r.checks if not c["passed"]] == CASES[case][1]
    assert r.passed == (not CASES[case][1])
    assert (r.package is None) == r.passed
    if not r.passed:
        assert [c["name"] for c in r.package.failed_checks] == CASES[case][1]


def test_texts(validated):
    good, wrong = validated["all good"], validated["wrong id"]
    assert good.summary.startswith("Validation PASSED (7/7 checks)\n  ✓ T1-Syntax: Python AST parse OK")
    assert "  ✗ T2-Sentinel: Missing sentinels: INTL:BEGIN [id=f001], INTL:END [id=f001]\n      → Expected sentinels for id=f001" in wrong.summary
    assert validated["no write"].checks[4]["message"] == "MUTATES ['users'] declared but no write operation found"
    assert validated["python syntax"].checks[0]["message"].startswith("Syntax error: ")


def model_balanced(text):
    previous = None
    text = re.sub(r"[^()\[\]{}]", "", text)
    while previous != text:
        previous, text = text, text.replace("()", "").replace("[]", "").replace("{}", "")
    return text == ""


def test_balance_model(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("()[]{}a") for _ in range(rng.randrange(0, 9))) for _ in range(400)]
    deep = "(" * 3000 + "[" * 3000
    texts += [deep + "]" * 3000 + ")" * 3000, deep + ")" * 3000 + "]" * 3000, deep]
    for n in (255, 256, 257, 511, 512, 513, 514, 769):  # around the pieces the walk keeps
        opened = [rng.choice("([{") for _ in range(n)]
        closed = "".join({"(": ")", "[": "]", "{": "}"}[c] for c in reversed(opened))
        texts += ["".join(opened) + closed, "".join(opened) + closed[:-1], "".join(opened) + closed[:-1] + "x)]"[n % 3]]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for r in df.select("t", C.balanced(F.col("t")).alias("ok")).collect():
        assert r.ok == model_balanced(r.t), r.t[:50]


WORDS = ["log", "Log.", "logger", "logs", "console.log(", ".info(", ".information", "emit", "Emits", "INSERT", "inserted", ".save(",
         "session.commit", "commit", "db.commit()", "é", "log_x", "ſend", "Keep", ".ADD", "TODO", "éTODO", "todo", "PlaceHolder", "\n pass \n", "pass"]


def test_word_model(spark):
    """Unicode-aware, case-insensitive search as Python's re does it."""
    rng = random.Random(2)
    texts = ["".join(rng.choice([*WORDS, " ", " ", "\n"]) for _ in range(rng.randrange(1, 6))) for _ in range(500)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    col, folded = F.col("t"), C.case_folded(F.col("t"))
    rows = df.select(
        "t", C.writes(col, folded).alias("w"), C.logs(col, folded).alias("l"), C.emits_events(col, folded).alias("e"),
        C.placeholders(col).alias("p"),
    ).collect()
    writes = [rf"\b{w}\b" for w in fixed.WRITE_WORDS] + [rf"\.{m}\b" for m in fixed.WRITE_METHODS] + [r"session\.commit\b", r"db\.commit\b"]
    logs = [r"\blog\b", r"\blogger\b", r"\.info\b", r"\.debug\b", r"\.warning\b", r"logging\.", r"console\.log", r"Log\.", "@observable", "@log"]
    emits = [rf"\b{w}\b" for w in fixed.EMIT_WORDS]
    found = lambda patterns, t: any(re.search(p, t, re.I) for p in patterns)
    for r in rows:
        assert (r.w, r.l, r.e) == (found(writes, r.t), found(logs, r.t), found(emits, r.t)), repr(r.t)
        labels = []
        for label, word in fixed.PLACEHOLDERS:
            pattern = r"^\s*pass\s*$" if label == "bare pass" else rf"\b{word}" + ("" if word.endswith(")") else r"\b")
            labels += [label] if re.search(pattern, r.t, re.I | re.M) else []
        assert r.p == labels, repr(r.t)


def test_gates(spark):
    rows = [
        ("FUNCTION f [id=f1]\n INTENT \"x\"\nEND FUNCTION f", "ok"),
        ("FUNCTION", fixed.NO_HEADER), ("  FUNCTION ", fixed.NO_HEADER), ("PATCH x", fixed.NO_INTENT), ("PIPELINE p INTENT", fixed.NO_END),
    ]
    df = spark.createDataFrame(rows, "t string, want string")
    assert all(r.got == r.want for r in df.select("want", C.block_reason(F.col("t")).alias("got")).collect())
    done = [
        ("x", fixed.NO_BEGIN_MARKER), ("INTL:BEGIN", fixed.NO_END_MARKER), ("INTL:BEGIN INTL:END", "ok"),
        ("INTL:BEGIN INTL:END TODO FIXME", "contains stub/placeholder: 'TODO'"), ("INTL:BEGIN INTL:END stubborn", "contains stub/placeholder: 'stub'"),
        ("INTL:BEGIN INTL:END todo", "ok"),
    ]
    df = spark.createDataFrame(done, "t string, want string")
    assert all(r.got == r.want for r in df.select("want", C.completion_reason(F.col("t")).alias("got")).collect())


def test_gate_rejects_missing_texts(spark):
    pairs = spark.createDataFrame([(None, "INTL:BEGIN INTL:END"), ("FUNCTION f INTENT END FUNCTION", None), ("FUNCTION f INTENT END FUNCTION", "INTL:BEGIN INTL:END")], "prompt string, completion string")
    accepted, rejected = V.quality_gate(pairs)
    assert accepted.count() == 1 and sorted(r.reason for r in rejected.collect()) == [fixed.NO_HEADER, fixed.NO_BEGIN_MARKER]


def test_manifests(spark):
    rows = [('{"modules": []}', "ok"), ('{"modules": {}}', "missing modules list"), ('{"a": 1}', "missing modules list"),
            ("nope", "invalid JSON"), ("[1]", "missing modules list"), ('{"modules": null}', "missing modules list")]
    df = spark.createDataFrame(rows, "t string, want string")
    assert [r.got for r in df.select(C.manifest_reason(F.col("t")).alias("got")).collect()] == [w for _, w in rows]


def test_marker_styles(spark):
    rows = [(f"{a}═══ INTL:BEGIN x\n{a}═ INTL:END", True) for a in ("# ", "-- ", "<!-- ", "/* ")]
    rows += [("code", False), ("# ═ INTL:BEGIN", False), ("// ═══ INTL:BEGIN // ═══ INTL:END", False)]
    df = spark.createDataFrame(rows, "t string, want boolean")
    assert [r.got for r in df.select(C.has_sentinels(F.col("t")).alias("got")).collect()] == [w for _, w in rows]


def test_slash_comments(spark):
    df = spark.createDataFrame([("x", "go_gin"), ("x", "ruby_rails")], "t string, p string")
    wrapped = T.wrap_sentinels(F.col("t"), F.lit("f1"), F.lit("n"), F.col("p"), slash=True)
    rows = df.select(wrapped.alias("w"), C.has_sentinels(wrapped).alias("plain"), C.has_sentinels(wrapped, slash=True).alias("slash")).collect()
    assert rows[0].w.startswith("// ═══ INTL:BEGIN") and rows[1].w.startswith("# ═══ INTL:BEGIN")
    assert [(r.plain, r.slash) for r in rows] == [(False, True), (True, True)]


def test_fail_if_strict(spark):
    df = spark.createDataFrame([(1,), (2,)], "x int")
    assert [r.x for r in V.fail_if(df, F.col("x") > 5, "E", "m", strict=True).collect()] == [1, 2]
    with pytest.raises(Exception, match="E: m"):
        V.fail_if(df, F.col("x") > 1, "E", "m", strict=True).collect()


def test_expect_and_types(spark):
    df = spark.createDataFrame([(1, "a"), (None, "b"), (7, None)], "x int, s string")
    kept, out = V.expect(df, {"small": "x < 5", "named": "s is not null"})
    assert [r.x for r in kept.collect()] == [1]
    assert sorted(r.broken_rules for r in out.collect()) == [["small"], ["small", "named"]]
    assert V.type_to_ddl("Map<String, Int[]>") == "map<string,array<bigint>>"
    assert V.type_to_ddl("DateTime?") == "timestamp" and V.type_to_ddl("String(20)") == "string"


def model_strip_fences(t):
    t = re.sub(r"^```[a-zA-Z]*\n?", "", t.strip())
    return re.sub(r"\n?```$", "", t.strip()).strip()


def test_fence_models(spark):
    rng = random.Random(3)
    parts = ["```", "```python", "```Sql\n", "code", "\n", " ", " ", "\x1c", "```\n", "FUNCTION ", "PATCH x", "x```", "\r\n", " "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 8))) for _ in range(600)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    rows = df.select("t", T.strip_fences(F.col("t")).alias("one"), T.strip_fences_all(F.col("t")).alias("all"),
                     T.strip_sentinels(F.col("t")).alias("lines"), T.extract_block(F.col("t")).alias("block")).collect()
    for r in rows:
        assert r.one == model_strip_fences(r.t), repr(r.t)
        every = re.sub(r"^```[a-z]*\s*", "", r.t, flags=re.M)
        assert r["all"] == re.sub(r"```\s*$", "", every, flags=re.M).strip(), repr(r.t)
        assert r.lines == "\n".join(r.t.splitlines()), repr(r.t)
        cut = next((model_strip_fences(r.t)[model_strip_fences(r.t).find(k):].strip() for k in fixed.BLOCK_KEYWORDS
                    if k in model_strip_fences(r.t)), model_strip_fences(r.t))
        assert r.block == cut, repr(r.t)


def test_wrap_and_strip(spark):
    rows = [("x = 1  \n\n", "python_flask"), ("a\nb", "sql_mysql"), ("<p>", "html_blade"), ("", "css_tailwind")]
    df = spark.createDataFrame(rows, "t string, p string")
    wrapped = T.wrap_sentinels(F.col("t"), F.lit("f1"), F.lit("n"), F.col("p"))
    for r in df.select("t", "p", wrapped.alias("w"), T.strip_sentinels(wrapped).alias("back")).collect():
        assert r.back == r.t.rstrip()
    assert df.select(wrapped.alias("w")).collect()[1].w == "-- ═══ INTL:BEGIN [id=f1] n ═══\na\nb\n-- ═══ INTL:END   [id=f1] n ═══"


def test_ids_and_types_of_any_characters(spark):
    ids = [r"a\Eb", "a]b", "a(b", 'q"q', "[x", "$1"]
    rows = [(i, f"# INTL:BEGIN [id={i}]\nx: T{i}y {i}\n# INTL:end [id={i.upper()}]") for i in ids]
    df = spark.createDataFrame(rows, "id string, code string")
    good = df.select(C.check_sentinel(F.col("code"), F.col("id")).passed.alias("s"), C.check_return_type(F.col("code"), F.concat(F.lit("T"), F.col("id"), F.lit("y"))).passed.alias("t")).collect()
    assert all(r.s and r.t for r in good)
    other = df.select(C.check_sentinel(F.col("code"), F.concat(F.lit("z"), F.col("id"))).passed.alias("s"), C.check_return_type(F.col("code"), F.concat(F.col("id"), F.lit("zz"))).passed.alias("t")).collect()
    assert not any(r.s or r.t for r in other)


def test_whole_words_equal_a_pattern_per_name(spark):
    """Names of conditions against a plain pattern with word edges, letters of all scripts included."""
    draw = random.Random(9)
    names = ["amount", "amount_due", "due", "x", "x1", "naïve", "größe", "été", "_id", "result", "日本", "a日"]
    rows = []
    for i in range(600):
        code = "".join(draw.choice([*names, " ", ".", "(", "-", "9", "é", "\n", "=="]) for _ in range(draw.randint(0, 14)))
        conditions = [draw.choice([" > ", ".", " and ", "9"]).join(draw.choices(names, k=draw.randint(0, 3))) for _ in range(draw.randint(0, 4))]
        rows.append((i, code, conditions + [None] * (i % 7 == 0)))
    df = spark.createDataFrame(rows, "i int, code string, conditions array<string>")
    known = C.known_names(F.col("code"), F.col("conditions"))
    got = df.select("i", C.unmapped_preconditions(known, F.col("conditions")).alias("open")).collect()

    def is_open(code, condition):
        found = [n for n in re.findall(r"[a-zA-Z_]\w*", condition or "") if n not in fixed.GUARD_STOP_WORDS]
        return not any(re.search(rf"(?<!\w){re.escape(n)}(?!\w)", code) for n in found)

    want = {i: [c for c in conditions if is_open(code, c)] for i, code, conditions in rows}
    assert {r.i: r.open for r in got} == want and sum(map(len, want.values())) > 300
