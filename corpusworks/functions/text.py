"""Cleaning, extraction and rendering of text columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusworks import fixed

# The characters a Unicode-aware strip removes, and the same set as a regex class.
SPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004"
    "\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"
WORD = r"[\p{L}\p{N}_]"
WORD_END = rf"(?!{WORD})"
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def strip(col: Column) -> Column:
    return F.btrim(col, F.lit(SPACE_CHARS))


def rstrip(col: Column) -> Column:
    return F.rtrim(col, F.lit(SPACE_CHARS))


def whole_words(words: list[str]) -> str:
    """Regex that finds any of the given patterns as a whole word (letters, digits, _).

    The word itself comes first and its left edge is tested afterwards, so that the search does
    not try a look-behind at every character of a long text.
    """
    return f"(?:{'|'.join(f'{w}(?<!{WORD}{w})' for w in words)}){WORD_END}"


def strip_fences(col: Column) -> Column:
    """Remove one opening and one closing code fence around the whole text."""
    text = strip(col)
    text = strip(F.when(text.startswith("```"), F.regexp_replace(text, r"\A```[a-zA-Z]*", "")).otherwise(text))
    return strip(F.when(text.endswith("```"), F.left(text, F.length(text) - 3)).otherwise(text))


def strip_fences_all(col: Column, lang: str = "[a-z]*") -> Column:
    """Remove every opening fence at a line start and every closing fence at a line end."""
    text = F.regexp_replace(col, rf"(?dm)^```{lang}{SPACE}*", "")
    return strip(F.regexp_replace(text, rf"(?dm)```{SPACE}*$", ""))


def extract_block(col: Column) -> Column:
    """Cut prose in front of a block; keywords are tried in priority order, not by position."""
    text = strip_fences(col)
    cuts = [F.when(text.contains(word), strip(F.substr(text, F.instr(text, word)))) for word in fixed.BLOCK_KEYWORDS]
    return F.coalesce(*cuts, text)


def split_batch(col: Column) -> Column:
    """Array of candidate blocks of one batched answer, blanks removed and prose cut."""
    chunks = F.transform(F.split(col, "---"), strip)
    return F.transform(F.filter(chunks, lambda c: c != ""), extract_block)


def comment_style(profile: Column, slash: bool = False) -> tuple[Column, Column]:
    """Opener and closer of a marker comment. With ``slash``, languages that know no # use //."""
    opener, closer = F.lit("# "), F.lit("")
    if slash:
        opener = F.when(F.substring_index(profile, "_", 1).isin(fixed.SLASH_LANGUAGES), "// ").otherwise(opener)
    for prefix, left, right in fixed.COMMENT_STYLES:
        opener = F.when(profile.startswith(prefix), left).otherwise(opener)
        closer = F.when(profile.startswith(prefix), right).otherwise(closer)
    return opener, closer


def wrap_sentinels(code: Column, block_id: Column, name: Column, profile: Column, slash: bool = False) -> Column:
    opener, closer = comment_style(profile, slash)
    begin = F.concat(opener, F.format_string(fixed.BEGIN_FORMAT, block_id, name), closer)
    end = F.concat(opener, F.format_string(fixed.END_FORMAT, block_id, name), closer)
    return F.concat_ws("\n", begin, rstrip(code), end)


def ensure_sentinels(code: Column, block_id: Column, name: Column, profile: Column) -> Column:
    return F.when(code.contains(fixed.BEGIN_TAG), code).otherwise(wrap_sentinels(code, block_id, name, profile))


def split_lines(col: Column) -> Column:
    """Lines without their breaks; a final break opens no further line, empty text has none."""
    parts = F.split(col, LINE_BREAK)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def strip_sentinels(code: Column) -> Column:
    return F.array_join(F.filter(split_lines(code), lambda line: ~line.rlike(fixed.MARKER_LINE)), "\n")


def adapter_display(profile: Column) -> Column:
    return F.initcap(F.replace(profile, F.lit("_"), F.lit(" ")))


def truncate_text(col: Column, n: int = fixed.SPEC_CHARS, notice: str = fixed.TRUNCATED) -> Column:
    return F.when(F.length(col) > n, F.concat(F.left(col, F.lit(n)), F.lit(notice))).otherwise(col)


def system_prompt(profile: Column, mode: Column | str, spec: Column | None = None) -> Column:
    """System text by mode: writer, compiler, patch or escalation; other modes give null."""
    mode = F.lit(mode) if isinstance(mode, str) else mode
    name = adapter_display(profile)
    spec = F.lit("") if spec is None else truncate_text(spec)
    return (
        F.when(mode == "compiler", F.format_string(fixed.COMPILER_PROMPT, name))
        .when(mode == "patch", F.format_string(fixed.PATCH_PROMPT, name))
        .when(mode == "escalation", F.format_string(fixed.ESCALATION_PROMPT, name))
        .when(mode == "writer", F.format_string(fixed.WRITER_PROMPT, spec))
    )


def training_text(system: Column, prompt: Column, completion: Column, eos: str) -> Column:
    return F.concat(system, F.lit("\n"), prompt, F.lit("\n"), completion, F.lit(eos))


def token_estimate(text: Column) -> Column:
    """Whitespace-separated pieces: an estimate, since the model's own tokenizer is not data."""
    trimmed = strip(text)
    return F.when(trimmed == "", 0).otherwise(F.regexp_count(trimmed, F.lit(rf"{SPACE}+")) + 1)


def normalised(col: Column) -> Column:
    """Prompt text as compared for duplicates: outer blanks removed, inner runs of blanks made one.

    A single plain space is a run already in its final form, so the pattern leaves it alone.
    """
    return F.regexp_replace(strip(col), rf" {SPACE}+|(?! ){SPACE}{SPACE}*", " ")


def text_key(col: Column) -> Column:
    """Key (32 bytes) of a normalised text, so shuffles carry keys and not texts."""
    return F.unhex(F.sha2(normalised(col), 256))
