"""Row checks of blocks, completions and compiled code."""

from __future__ import annotations

import ast
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from corpusworks import fixed
from corpusworks.functions.text import SPACE, WORD, WORD_END, strip, whole_words

IDENTIFIER = rf"[a-zA-Z_]{WORD}*"

CHECK_TYPE = "struct<name:string,passed:boolean,message:string,detail:string>"


def _any_of(texts: list[str], col: Column) -> Column:
    found = F.lit(False)
    for text in texts:
        found = found | col.contains(text)
    return found


def given(value: Column, fn: Callable[[Column], Column]) -> Column:
    """fn(value) with value computed once, however often fn reads it."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def case_folded(col: Column) -> Column:
    """Text in which a plain search finds every case variant (long s, Kelvin sign and dotless i
    included). Only a pre-filter: expansions such as ß → SS may find too much, never too little."""
    return F.upper(F.lower(col))


def _search(code: Column, folded: Column, words: list[str], pattern: str) -> Column:
    """Case-insensitive regex search behind a plain search for the words it needs, which costs
    a fraction of the regex on the many texts that hold none of them."""
    return _any_of([w.upper() for w in words], folded) & code.rlike("(?iu)" + pattern)


# --- gates on blocks and completions ----------------------------------------------------------
def block_reason(col: Column) -> Column:
    """'ok', or why the text does not look like a block; the first reason wins. Null is empty text."""
    col = F.coalesce(col, F.lit(""))
    header = given(strip(col), lambda text: _any_of(fixed.BLOCK_KEYWORDS, text))
    return (
        F.when(~header, fixed.NO_HEADER)
        .when(~col.contains("INTENT"), fixed.NO_INTENT)
        .when(~_any_of(fixed.BLOCK_ENDS, col), fixed.NO_END)
        .otherwise("ok")
    )


def completion_reason(col: Column) -> Column:
    """'ok', or why the compiled text may not enter a corpus; the first reason wins. Null is empty text."""
    col = F.coalesce(col, F.lit(""))
    reason = F.when(~col.contains(fixed.BEGIN_TAG), fixed.NO_BEGIN_MARKER).when(
        ~col.contains(fixed.END_TAG), fixed.NO_END_MARKER
    )
    for stub in fixed.STUBS:
        reason = reason.when(col.contains(stub), fixed.STUB_FOUND % stub)
    return reason.otherwise("ok")


def is_patch_text(col: Column) -> Column:
    return col.contains("PATCH") & col.contains("INTENT")


def starts_with_patch(col: Column) -> Column:
    return F.upper(F.left(col, F.lit(5))) == "PATCH"


def manifest_reason(col: Column) -> Column:
    """'ok', 'invalid JSON' or 'missing modules list'."""
    parsed = F.try_parse_json(col)
    kind = F.schema_of_variant(F.try_variant_get(parsed, "$.modules", "variant"))
    return (
        F.when(parsed.isNull(), "invalid JSON")
        .when(F.coalesce(kind.startswith("ARRAY"), F.lit(False)), "ok")
        .otherwise("missing modules list")
    )


def has_sentinels(col: Column, slash: bool = False) -> Column:
    """A BEGIN and an END marker in a known comment style; ``slash`` also takes // comments."""
    opener = "|".join([*fixed.COMMENT_OPENERS, *(["//"] if slash else [])])
    begin = rf"(?:{opener}){SPACE}*═+{SPACE}*{fixed.BEGIN_TAG}"
    end = rf"(?:{opener}){SPACE}*═+{SPACE}*{fixed.END_TAG}"
    return col.rlike(begin) & col.rlike(end)


# --- syntax -------------------------------------------------------------------------------------
@F.pandas_udf(StringType())
def python_problem(code: pd.Series) -> pd.Series:
    """'' when the text parses as Python, else the parser's message; nulls are skipped."""

    def problem(text):
        if text is None:
            return None
        try:
            ast.parse(text)
            return ""
        except SyntaxError as error:
            return f"Syntax error: {error}\n{error}"
        except Exception as error:  # noqa: BLE001 - any parser failure is the row's result
            return f"Parse check error: {error}\n"

    return code.map(problem, na_action=None)


def brackets_of(col: Column) -> Column:
    """Only the brackets of a text, with directly closed pairs already taken out."""
    marks = F.regexp_replace(col, r"[^()\[\]{}]+", "")
    for _ in range(3):
        marks = F.regexp_replace(marks, r"\(\)|\[\]|\{\}", "")
    return marks


def balanced(col: Column) -> Column:
    return balanced_marks(brackets_of(col))


def balanced_marks(marks: Column) -> Column:
    """True if every bracket of a bracket-only string closes the latest open one.

    The walk keeps the open brackets as two strings, the latest few hundred and the rest, so a step
    copies a short string however deep the nesting is.
    """
    keep = 256

    def state(top: Column, rest: Column) -> Column:
        return F.struct(top.alias("top"), rest.alias("rest"))

    def step(open_ones: Column, mark: Column) -> Column:
        top, rest = open_ones.top, open_ones.rest
        latest, size = F.right(top, F.lit(1)), F.length(top)
        opens = mark.isin("(", "[", "{")
        closes = ((mark == ")") & (latest == "(")) | ((mark == "]") & (latest == "[")) | ((mark == "}") & (latest == "{"))
        return (
            F.when(top == "!", open_ones)
            .when(opens & (size < 2 * keep), state(F.concat(top, mark), rest))
            .when(opens, state(F.concat(F.substring(top, keep + 1, 2 * keep), mark), F.concat(rest, F.left(top, F.lit(keep)))))
            .when(closes & ((size > 1) | (rest == "")), state(F.left(top, size - 1), rest))
            .when(closes, state(F.right(rest, F.lit(keep)), F.left(rest, F.length(rest) - keep)))
            .otherwise(state(F.lit("!"), F.lit("")))
        )

    start = state(F.lit(""), F.lit(""))
    return F.when(marks == "", True).otherwise(F.aggregate(F.split(marks, ""), start, step, lambda s: s.top == ""))


def _check(name: str, passed: Column, message: Column, detail: Column) -> Column:
    return F.struct(
        F.lit(name).alias("name"),
        passed.alias("passed"),
        message.alias("message"),
        F.when(passed, "").otherwise(detail).alias("detail"),
    )


def uses_python_parser(profile: Column) -> Column:
    return profile.startswith("python")


def uses_brackets(profile: Column) -> Column:
    return ~profile.rlike("^(?:python|sql|html|css)")


def _syntax_check(outcome: Column, good: Column) -> Column:
    """``outcome`` is empty when the text passes, else the message, and the detail behind a line break."""

    def fold(found: Column) -> Column:
        message = F.when(found == "", good).otherwise(F.substring_index(found, "\n", 1))
        return _check(fixed.CHECK_NAMES[0], found == "", message, F.substring_index(found, "\n", -1))

    return given(outcome, fold)


def check_parsed(code: Column) -> Column:
    """The syntax check of profiles with a parser."""
    return _syntax_check(F.coalesce(python_problem(code), F.lit("")), F.lit("Python AST parse OK"))


def check_rules(
    code: Column, profile: Column, marks: Column | None = None, folded: Column | None = None
) -> Column:
    """The syntax check of all other profiles, by prefix. ``marks`` and ``folded`` may carry
    brackets_of(code) and case_folded(code) computed beforehand."""
    folded = case_folded(code) if folded is None else folded
    is_script = profile.startswith("typescript") | profile.startswith("javascript")
    closes = balanced_marks(brackets_of(F.when(uses_brackets(profile), code)) if marks is None else marks)
    sql = _search(code, folded, fixed.SQL_WORDS, whole_words(fixed.SQL_WORDS))
    html = code.rlike(fixed.HTML_TAG)
    css = code.contains("{") & code.rlike(CSS_RULE)
    outcome = (
        F.when(profile.startswith("sql"), F.when(sql, "").otherwise("No SQL keyword found in output\n"))
        .when(profile.startswith("html"), F.when(html, "").otherwise("No HTML tag found in output\n"))
        .when(profile.startswith("css"), F.when(css, "").otherwise("No CSS rule found in output\n"))
        .when(closes, "")
        .when(is_script, "Unbalanced braces/brackets\nBrace balance check failed")
        .otherwise("Unbalanced braces/brackets\n")
    )
    good = (
        F.when(is_script, "Brace balance OK")
        .when(profile.startswith("sql"), "SQL keyword present")
        .when(profile.startswith("html"), "HTML tag present")
        .when(profile.startswith("css"), "CSS rule present")
        .otherwise("Brace balance OK (fallback)")
    )
    return _syntax_check(outcome, good)


CSS_RULE = rf"(?:{WORD}|-){SPACE}*\{{"


def check_sentinel(code: Column, block_id: Column) -> Column:
    block_id = F.coalesce(block_id, F.lit(""))

    def marker(tag: str) -> Column:
        # What follows each tag on its line is compared as text, so an id may hold any characters.
        tails = F.regexp_extract_all(code, F.lit(rf"(?iu){tag}{SPACE}+\[id=(?=([^\n]*))"), F.lit(1))
        wanted = case_folded(F.concat(block_id, F.lit("]")))
        return F.coalesce(F.exists(tails, lambda t: case_folded(t).startswith(wanted)), F.lit(False))

    missing = F.concat_ws(
        ", ",
        F.when(~marker(fixed.BEGIN_TAG), F.concat(F.lit(fixed.BEGIN_TAG + " [id="), block_id, F.lit("]"))),
        F.when(~marker(fixed.END_TAG), F.concat(F.lit(fixed.END_TAG + " [id="), block_id, F.lit("]"))),
    )

    def fold(absent: Column) -> Column:
        message = F.when(absent == "", "BEGIN/END sentinels present").otherwise(
            F.concat(F.lit("Missing sentinels: "), absent)
        )
        return _check(
            fixed.CHECK_NAMES[1], absent == "", message, F.concat(F.lit("Expected sentinels for id="), block_id)
        )

    return given(missing, fold)


def identifiers(expression: Column, stop_words: list[str] = ()) -> Column:
    """Distinct names in an expression string, stop words left out."""
    names = F.regexp_extract_all(expression, F.lit(rf"({IDENTIFIER})"), F.lit(1))
    if not stop_words:
        return F.array_distinct(names)
    return F.array_except(names, F.array(*[F.lit(w) for w in stop_words]))


def word_set(code: Column) -> Column:
    """The distinct words of a text."""
    return F.array_distinct(F.regexp_extract_all(code, F.lit(f"({WORD}+)"), F.lit(1)))


def known_names(code: Column, *expressions: Column) -> Column:
    """The names in some lists of expressions that are whole words of the text.

    Names are word characters only, so a name is a whole word exactly if it is in the text's word set: one pass
    over the text whatever the number of names, no pattern per name. Texts that hold no name at all, by a plain
    search, build no set.
    """
    lists = [F.coalesce(e, F.array().cast("array<string>")) for e in expressions]
    wanted = F.flatten(F.transform(F.concat(*lists), lambda e: F.coalesce(identifiers(e), F.array().cast("array<string>"))))

    def found(names: Column) -> Column:
        return F.when(F.size(names) > 0, F.array_intersect(names, word_set(code))).otherwise(names)

    return given(F.filter(F.array_distinct(wanted), lambda n: code.contains(n)), found)


def unmapped_preconditions(known: Column, preconditions: Column) -> Column:
    """Expressions none of whose names is known; those without names too."""

    def is_open(expression: Column) -> Column:
        return ~F.coalesce(F.arrays_overlap(identifiers(expression, fixed.GUARD_STOP_WORDS), known), F.lit(False))

    return F.filter(preconditions, is_open)


def unmapped_postconditions(known: Column, postconditions: Column) -> Column:
    """Expressions with names none of which is known."""

    def is_open(expression: Column) -> Column:
        names = identifiers(expression, fixed.RESULT_STOP_WORDS)
        return (F.size(names) > 0) & ~F.arrays_overlap(names, known)

    return F.filter(postconditions, is_open)


def _is_empty(items: Column) -> Column:
    return items.isNull() | (F.size(items) == 0)


def check_preconditions(code: Column, preconditions: Column, known: Column | None = None) -> Column:
    """``known``: the names found in the text, if they are at hand (see known_names)."""
    known = known_names(code, preconditions) if known is None else known
    empty = _is_empty(preconditions)

    def fold(missing: Column) -> Column:
        passed = empty | (F.size(missing) == 0)
        message = (
            F.when(empty, "No preconditions to check")
            .when(passed, F.format_string("All %d precondition(s) mapped", F.size(preconditions)))
            .otherwise(F.format_string("%d precondition(s) not mapped in output", F.size(missing)))
        )
        detail = F.concat(F.lit("Missing guards for: "), F.array_join(missing, "; "))
        return _check(fixed.CHECK_NAMES[2], passed, message, detail)

    return given(unmapped_preconditions(known, preconditions), fold)


def check_postconditions(code: Column, postconditions: Column, known: Column | None = None) -> Column:
    """``known`` as in check_preconditions."""
    known = known_names(code, postconditions) if known is None else known
    empty = _is_empty(postconditions)
    returns = F.lit(False)
    for word in fixed.RESULT_WORDS:
        returns = returns | (code.contains(word) & code.rlike(whole_words([word])))
    open_ones = F.when(returns, unmapped_postconditions(known, postconditions))

    def fold(missing: Column) -> Column:
        passed = empty | F.coalesce(F.size(missing) == 0, F.lit(False))
        message = (
            F.when(empty, "No postconditions to check")
            .when(missing.isNull(), "No return/result expression found in output")
            .when(passed, F.format_string("All %d postcondition(s) mapped", F.size(postconditions)))
            .otherwise(F.format_string("%d postcondition(s) not verified in output", F.size(missing)))
        )
        detail = F.when(
            missing.isNull(), F.concat(F.lit("Postconditions: "), F.array_join(postconditions, "; "))
        ).otherwise(F.concat(F.lit("Unverified: "), F.array_join(missing, "; ")))
        return _check(fixed.CHECK_NAMES[3], passed, message, detail)

    return given(open_ones, fold)


def _methods(names: list[str]) -> str:
    return rf"\.(?:{'|'.join(names)}){WORD_END}"


def _texts(texts: list[str]) -> str:
    return "|".join(t.replace(".", r"\.") for t in texts)


def writes(code: Column, folded: Column) -> Column:
    return (
        _search(code, folded, fixed.WRITE_WORDS, whole_words(fixed.WRITE_WORDS))
        | _search(code, folded, fixed.WRITE_METHODS, _methods(fixed.WRITE_METHODS))
        | _search(code, folded, ["commit"], f"(?:{_texts(fixed.WRITE_CALLS)}){WORD_END}")
    )


def logs(code: Column, folded: Column) -> Column:
    return (
        _search(code, folded, fixed.LOG_METHODS, _methods(fixed.LOG_METHODS))
        | _search(code, folded, ["log"], whole_words(fixed.LOG_WORDS))
        | _search(code, folded, ["log", "@observable"], _texts(fixed.LOG_TEXTS))
    )


def emits_events(code: Column, folded: Column) -> Column:
    return _search(code, folded, fixed.EMIT_WORDS, whole_words(fixed.EMIT_WORDS))


def _listed(items: Column) -> Column:
    """['a', 'b'] as messages print lists."""
    return F.concat(F.lit("['"), F.array_join(items, "', '"), F.lit("']"))


def check_side_effects(
    code: Column, mutates: Column, observable: Column, emits: Column, folded: Column | None = None
) -> Column:
    folded = case_folded(code) if folded is None else folded
    issues = F.concat_ws(
        "; ",
        F.when(
            ~_is_empty(mutates) & ~writes(code, folded),
            F.concat(F.lit("MUTATES "), _listed(mutates), F.lit(" declared but no write operation found")),
        ),
        F.when(observable & ~logs(code, folded), "OBSERVABLE declared but no logging call found"),
        F.when(
            ~_is_empty(emits) & ~emits_events(code, folded),
            F.concat(F.lit("EMITS "), _listed(emits), F.lit(" declared but no event emit found")),
        ),
    )

    def fold(found: Column) -> Column:
        message = F.when(found == "", "All side effects accounted for").otherwise(found)
        return _check(fixed.CHECK_NAMES[4], found == "", message, F.lit(""))

    return given(issues, fold)


def check_return_type(code: Column, return_type: Column) -> Column:
    empty = return_type.isNull() | (return_type == "")
    # Whole word as a regex engine sees it: an outer edge of the type that is no word character
    # needs a word character next to it, so the boundary test follows the edge.
    edge = rf"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"
    quoted = F.replace(return_type, F.lit("\\E"), F.lit("\\E\\\\E\\Q"))  # the type may hold the end of a quotation
    pattern = F.concat(F.lit(rf"{edge}\Q"), quoted, F.lit(rf"\E{edge}"))

    def fold(passed: Column) -> Column:
        message = (
            F.when(empty, "No TYPE declaration to check")
            .when(passed, F.format_string("Return type '%s' found in output", return_type))
            .otherwise(F.format_string("Return type '%s' not found in compiled output", return_type))
        )
        return _check(fixed.CHECK_NAMES[5], passed, message, F.format_string("Expected to find '%s' in output", return_type))

    return given(empty | (code.contains(return_type) & F.regexp_like(code, pattern)), fold)


def _placeholder_pattern(label: str, pattern: str) -> str:
    if label == "bare pass":
        return rf"(?dm)^{SPACE}*{pattern}{SPACE}*$"
    if pattern.endswith(r"\)"):
        return rf"{pattern}(?<!{WORD}{pattern})"
    return whole_words([pattern])


def placeholders(code: Column, folded: Column | None = None) -> Column:
    """Labels of the placeholder forms a text contains, in fixed order."""
    folded = case_folded(code) if folded is None else folded
    found = [
        F.when(_search(code, folded, [word.replace("\\", "")], _placeholder_pattern(label, word)), F.lit(label))
        for label, word in fixed.PLACEHOLDERS
    ]
    return F.array_compact(F.array(*found))


def check_placeholders(code: Column, folded: Column | None = None) -> Column:
    def fold(found: Column) -> Column:
        message = F.when(F.size(found) == 0, "No placeholders found").otherwise(
            F.concat(F.lit("Placeholder(s) found: "), F.array_join(found, ", "))
        )
        return _check(
            fixed.CHECK_NAMES[6], F.size(found) == 0, message, F.lit("Output contains incomplete code markers")
        )

    return given(placeholders(code, folded), fold)


# --- folding the checks -----------------------------------------------------------------------
def validation_summary(checks: Column) -> Column:
    """Status line, then one line per check, with the detail below a failed one."""
    good = F.size(F.filter(checks, lambda c: c.passed))
    status = F.when(good == F.size(checks), "PASSED").otherwise("FAILED")

    def line(check: Column) -> Column:
        head = F.concat(
            F.when(check.passed, "  ✓ ").otherwise("  ✗ "), check["name"], F.lit(": "), check["message"]
        )
        tail = F.when(~check.passed & (check.detail != ""), F.concat(F.lit("\n      → "), check.detail)).otherwise("")
        return F.concat(head, tail)

    head = F.format_string("Validation %s (%d/%d checks)", status, good, F.size(checks))
    return F.concat(head, F.lit("\n"), F.array_join(F.transform(checks, line), "\n"))
