"""Secret scans: candidates judged by a random forest that is learned from labelled findings.

Long tokens with digits or inner capitals are candidates, and so are values of any form behind an
assignment to a telling name and the passwords of URLs. The forest looks at their length, how
usual their character transitions are, how far dictionary words cover them, the path they come from
and the words around them, and tells secrets from false positives.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusworks.llm.common import arrow_map, bounded, by_bytes, materialise

#: Rows and their first characters that lend words to the labelled findings, and labelled findings made.
SOURCE_ROWS, ROW_CHARS, LABELLED = 400, 4_000, 4_000
#: Most frequent words and character pairs of the whole corpus that are kept, and words counted before counts are passed on.
DICTIONARY, PAIRS, COUNTED = 50_000, 50_000, 200_000
TREES, DEPTH, LEAST = 30, 9, 3
THRESHOLD = 0.5
MASK = "[SECRET]"
_PATH = "_path_of_the_row"

_CANDIDATE = re.compile(r"[A-Za-z0-9+/_~-]{12,}={0,2}")
# The value after a telling name and a sign of assignment: quoted, or up to white space, a quote or the next name of a query string.
_SIGN = re.compile(r"[:=]")
_NAME_BEFORE = re.compile(
    r"""(?:passw(?:or)?d|passphrase|pwd|pass|secret|token|api[_-]?key|auth[_-]?key|access[_-]?key|private[_-]?key|credentials?)"""
    r"""(?:[_-][A-Za-z0-9_-]{0,40})?["'`]?[ \t]{0,8}\Z""",
    re.I,
)
_NAME_SIZE = 64  # characters that such a name and what follows it can take
_ASSIGNED = re.compile(
    r"""(?::=|=>|=|:)[ \t]{0,8}"""
    r"""(?:"([^"\n]{6,512})"|'([^'\n]{6,512})'|`([^`\n]{6,512})`|((?:(?![&;,][A-Za-z_][A-Za-z0-9_.-]{0,40}=)[^\s"'`<>]){6,}))"""
)
_URL_PASSWORD = re.compile(r"://[^\s:/@?#\"'<>]{0,256}:([^\s/@\"'<>]{6,512})@")
_SPLIT = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_WORD = re.compile(r"[^\W\d_]+")
_LONG = 1_000_000
_CLASSES = {**{c: 0 for c in "abcdefghijklmnopqrstuvwxyz"}, **{c: 1 for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}, **{c: 2 for c in "0123456789"}}
_TELLING = frozenset("password passwd pwd secret token key apikey auth credential credentials bearer access private client aws api".split())
_HARMLESS = frozenset("commit sha sha1 sha256 md5 hash checksum digest uuid id guid isbn doi version build revision phone tel card order number img image src href".split())
_PATHS = re.compile(r"test|example|sample|mock|fixture|doc|vendor|lock", re.I)
_STARTS = re.compile(r"(?:AKIA|ASIA|gh[pousr]_|sk-|sk_|pk_|xox[abp]-|AIza|eyJ|glpat-|npm_)")
#: Marks of variables, calls and placeholders; and what stands before a URL's password.
_HOLDS_PLACE = re.compile(r"^[$<{%\[(]|\(|[{}]|\.\.\.|x{4}|\*{3}|your[_-]|example|change[_-]?me|placeholder|^(?:none|null|true|false|undefined|required|optional|string)$", re.I)
_URL_LEFT = re.compile(r"://[^\s:/@]{0,64}:$")
NAMES = ["length", "transitions", "rarest", "switches", "digits", "capitals", "entropy", "hex", "words", "start", "telling", "harmless", "assigned", "quoted", "path", "marks", "commonest", "plain", "in_url"]


@dataclass
class Surroundings:
    """What is usual in the corpus: log share of character pairs in words, and frequent words."""

    pairs: dict[str, float]
    floor: float
    dictionary: frozenset[str]


@dataclass
class SecretModel:
    usual: Surroundings
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


def _valued(text: str) -> Iterator[tuple[int, str]]:
    """(start, value) of assignments to telling names and of passwords in URLs."""
    at, sign = 0, _SIGN.search(text)
    while sign:
        p = sign.start()
        m = _ASSIGNED.match(text, p) if _NAME_BEFORE.search(text[max(at, p - _NAME_SIZE) : p]) else None
        if not m:
            sign = _SIGN.search(text, p + 1)
            continue
        at, sign, group = m.end(), _SIGN.search(text, m.end()), m.lastindex
        value = m[group] if group < 4 else m[group].rstrip(".,;:)]}")
        if len(value) >= 6 and not value.startswith("//"):
            yield m.start(group), value
    if "://" in text:
        for m in _URL_PASSWORD.finditer(text):
            yield m.start(1), m[1]


def candidates(text: str) -> list[tuple[int, str]]:
    """(start, token) in order, none overlapping.

    Values of 6 or more characters behind an assignment to a telling name (quoted, or up to white space
    without the punctuation that ends it) and passwords of URLs; elsewhere runs of 12 or more characters
    with a digit, or of 16 or more with a capital behind the first.
    """
    out, free = [], 0
    for start, value in sorted(_valued(text)):
        if start >= free:
            out.append((start, value))
            free = start + len(value)
    k, valued = 0, len(out)
    for m in _CANDIDATE.finditer(text):
        token = m[0]
        if token.isalpha() and (len(token) < 16 or token[1:].islower()):
            continue
        if not any(c in "0123456789" for c in token) and (len(token) < 16 or token[1:].lower() == token[1:]):
            continue
        while k < valued and out[k][0] + len(out[k][1]) <= m.start():
            k += 1
        if k == valued or out[k][0] >= m.end():
            out.append((m.start(), token))
    return sorted(out)


def _counted(texts: Iterable[str]) -> Iterator[tuple[Counter, Counter]]:
    """(words of 4 or more letters, character pairs) of texts, without their long tokens that are no plain words.

    Counts are given out whenever COUNTED words have come together, so they come in parts.
    """
    seen = Counter()

    def parts() -> tuple[Counter, Counter]:
        words, pairs = Counter(), Counter()
        for word, n in seen.items():
            low = word.lower()
            if len(low) >= 4:
                words[low] += n
            for i in range(len(low) - 1):
                pairs[low[i : i + 2]] += n
        return words, pairs

    for text in texts:
        plain = _CANDIDATE.sub(lambda m: m[0] if m[0][1:].isalpha() and m[0][1:].islower() else " ", text)
        for at in _WORD.finditer(plain) if len(plain) > _LONG else ():
            seen[at[0]] += 1
            if len(seen) >= COUNTED:
                yield parts()
                seen.clear()
        if len(plain) <= _LONG:
            seen.update(_WORD.findall(plain))
        if len(seen) >= COUNTED:
            yield parts()
            seen.clear()
    if seen:
        yield parts()


def _usual(words: Iterable[tuple[str, int]], pairs: Iterable[tuple[str, int]], total: int) -> Surroundings:
    return Surroundings({p: math.log((n + 0.5) / (total + 1)) for p, n in pairs}, math.log(0.5 / (total + 1)), frozenset(w for w, _ in words))


def learn_usual(texts: list[str]) -> Surroundings:
    """Surroundings of some texts, without their long tokens that are no plain words."""
    words, pairs = Counter(), Counter()
    for some, two in _counted(texts):
        words.update(some)
        pairs.update(two)
    return _usual(_frequent(words, DICTIONARY), _frequent(pairs, PAIRS), sum(pairs.values()))


def _frequent(counts: Counter, most: int) -> list[tuple[str, int]]:
    """Entries above the least count that at most ``most`` entries lie above."""
    cut = sorted(counts.values(), reverse=True)[most] if len(counts) > most else 0
    return [(key, n) for key, n in counts.items() if n > cut]


def usual_of(docs: DataFrame) -> Surroundings:
    """Surroundings of all whole texts: counts per partition, added by a shuffle; the most frequent reach the driver."""

    def run(batches):
        texts = (t for batch in by_bytes(batches) for t in batch.column("text").to_pylist())
        for parts in _counted(texts):
            for pair, counts in enumerate(parts):
                keys, n = list(counts), len(counts)
                yield pa.RecordBatch.from_arrays([pa.array([bool(pair)] * n, pa.bool_()), pa.array(keys, pa.string()), pa.array(counts.values(), pa.int64())], names=["pair", "key", "n"])

    counts = arrow_map(docs.select("text").where("text is not null"), run, "pair boolean, key string, n long")
    counts = materialise(counts.groupBy("pair", "key").agg(F.sum("n").alias("n")), "usual")
    total = counts.where("pair").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n

    def most(rows: DataFrame, count: int) -> list[tuple[str, int]]:
        low, high = -1, rows.agg(F.coalesce(F.max("n"), F.lit(0)).alias("n")).first().n
        while high - low > 1:  # the least count that at most `count` rows lie above; one small row per step
            tried = sorted({low + (high - low) * k // 32 for k in range(1, 33)} - {low})
            above = rows.agg(*[F.count_if(F.col("n") > t).alias(str(t)) for t in tried]).first()
            fits = next(i for i, t in enumerate(tried) if above[str(t)] <= count or t == high)
            low, high = (tried[fits - 1] if fits else low), tried[fits]
        return [(r.key, r.n) for r in rows.where(F.col("n") > high).select("key", "n").collect()]

    return _usual(most(counts.where("not pair"), DICTIONARY), most(counts.where("pair"), PAIRS), total)


def _covered(token: str, dictionary: frozenset[str]) -> float:
    """Share of the token's characters under dictionary words of 4 or more letters, longest first."""
    low, at, n = token.lower(), 0, 0
    while at < len(low) - 3:
        size = next((k for k in range(min(14, len(low) - at), 3, -1) if low[at : at + k] in dictionary), 0)
        n, at = n + size, at + (size or 1)
    return n / len(low)


def describe(token: str, before: str, after: str, path: str, usual: Surroundings) -> list[float]:
    """Numbers of one candidate, in the order of NAMES. ``before`` and ``after``: the text next to it."""
    low = token.lower()
    steps = [usual.pairs.get(low[i : i + 2], usual.floor) for i in range(len(low) - 1)]
    kinds = [_CLASSES.get(c, 3) for c in token]
    n, counts = len(token), Counter(token)
    near = [w.lower() for w in _SPLIT.findall(before[-48:])[-4:]]
    left = before.rstrip()
    quoted = left[-1:] in "\"'`" and after[:1] in "\"'`" and left[-1:] != ""
    left = left.rstrip("\"'` ")
    return [
        n,
        sum(steps) / len(steps),
        sum(s <= usual.floor + 1 for s in steps) / len(steps),
        sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / n,
        kinds.count(2) / n,
        kinds.count(1) / n,
        -sum(c / n * math.log2(c / n) for c in counts.values()),
        float(all(c in "0123456789abcdefABCDEF" for c in token)),
        _covered(token, usual.dictionary),
        float(bool(_STARTS.match(token))),
        float(any(w in _TELLING for w in near)),
        float(any(w in _HARMLESS for w in near)),
        float(left[-1:] in ("=", ":", ">")),
        float(quoted),
        float(bool(_PATHS.search(path))),
        kinds.count(3) / n,
        max(counts.values()) / n,
        float(bool(_HOLDS_PLACE.search(token))),
        float(bool(_URL_LEFT.search(before))),
    ]


def labelled_findings(words: list[str], count: int = LABELLED, seed: int = 11) -> list[tuple[str, str, str, str, int]]:
    """(token, before, after, path, label): findings whose label is known because they are made by rule.

    Secrets are random keys of common makes, bare or assigned; the others are what such scans trip
    over: long words and names, paths, hashes, numbers, ids and placeholder values.
    """
    draw = random.Random(seed)
    words = [w for w in words if 2 <= len(w) <= 30] or ["word", "text", "long", "name"]
    lower, upper, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"

    def chars(alphabet: str, least: int, most: int) -> str:
        return "".join(draw.choice(alphabet) for _ in range(draw.randint(least, most)))

    def around() -> str:
        return " ".join(draw.choice(words) for _ in range(draw.randint(0, 6)))

    def joined(least: int, most: int, how) -> str:
        return "".join(how(draw.choice(words)) for _ in range(draw.randint(least, most)))

    alnum = lower + upper + digits
    makes = [
        lambda: "AKIA" + chars(upper + "234567", 16, 16),
        lambda: "AKIA" + chars(upper + digits, 16, 16),
        lambda: draw.choice(["ghp_", "gho_", "npm_"]) + chars(alnum, 36, 36),
        lambda: draw.choice(["sk-", "sk_live_", "pk_live_"]) + chars(alnum, 24, 48),
        lambda: "AIza" + chars(alnum + "_-", 35, 35),
        lambda: "eyJ" + chars(alnum + "_-", 20, 120),
    ]
    assigned = [lambda: chars("0123456789abcdef", 14, 64), lambda: chars(alnum, 14, 64), lambda: chars(alnum + "+/", 16, 88) + draw.choice(["", "=", "=="])]
    names = ["password", "passwd", "secret", "token", "api_key", "apikey", "auth_token", "access_key", "client_secret", "PASSWORD", "TOKEN", "SECRET_KEY", "aws_secret_access_key"]
    signs = ["=", ":", " = ", ": ", ' = "', '="', "='", ' : "']
    harmless = [
        lambda: (joined(2, 5, str.lower).capitalize(), ""),
        lambda: (joined(2, 5, str.upper), ""),
        lambda: (joined(2, 4, str.capitalize), ""),
        lambda: (joined(1, 3, str.lower) + "_" + joined(1, 2, str.lower) + str(draw.randint(1, 99)), ""),
        lambda: ("/" + "/".join(joined(1, 2, str.lower) for _ in range(3)) + draw.choice(["", "/2024", "/v2"]), "https:"),
        lambda: ("-".join(joined(1, 1, str.lower) for _ in range(4)) + "-" + str(draw.randint(1, 2030)), ""),
        lambda: (chars(digits, 12, 19), draw.choice(["card ", "phone ", "", "order number "])),
        lambda: ("-".join(chars(digits, 2, 4) for _ in range(4)), ""),
        lambda: (chars("0123456789abcdef", 40, 40), draw.choice(["commit ", "sha ", "revision "])),
        lambda: (chars("0123456789abcdef", 32, 64), draw.choice(["md5 ", "sha256: ", "checksum=", "digest: "])),
        lambda: ("-".join(chars("0123456789abcdef", k, k) for k in (8, 4, 4, 4, 12)), draw.choice(["id=", "uuid: ", "guid "])),
        lambda: (draw.choice(["your_password_here1", "changeme12345", "xxxxxxxxxxxx1234", "example_token_123", "000000000000000"]), draw.choice(names) + draw.choice(signs)),
        lambda: (joined(2, 3, str.lower) + str(draw.randint(1, 999)), ""),
    ]
    marks = "!@#$%^&*?-_.+"

    def short_secret() -> str:
        """A password that people choose or that is drawn for them."""
        word = lambda: draw.choice(words)[:10]
        form = draw.random()
        if form < 0.2:
            return word() + chars(digits, 1, 4)
        if form < 0.4:
            return word().capitalize() + draw.choice(marks) + chars(digits, 1, 5) + chars(marks, 0, 2)
        if form < 0.55:
            return word() + draw.choice(marks) + word() + draw.choice(marks) + word() + chars(digits, 0, 2)
        if form < 0.7:
            return "".join(draw.choice(alnum + marks) for _ in range(draw.randint(7, 24)))
        if form < 0.8:
            return chars(lower, 14, 30)
        if form < 0.85:
            at = draw.randint(0, 12)
            return lower[at : at + draw.randint(12, 26)]
        return "".join({"a": "4", "e": "3", "o": "0", "s": "5", "i": "1"}.get(c, c) if draw.random() < 0.7 else c for c in word() + word()[:4]) + chars(digits + marks, 1, 4)

    def placeholder() -> str:
        name = joined(1, 2, str.lower)
        return draw.choice(
            ["${%s}" % name.upper(), "$" + name.upper(), "<%s>" % name, "{{ %s }}" % name, "os.environ[%s]" % name, "getenv(%s)" % name, "get_%s()" % name, "********", "xxxxxxxx",
             "your_%s_here" % name, "your-%s" % name, "changeme", "undefined", "required", "string", "example_" + name, "config.%s.%s" % (name, draw.choice(words)), "..." + "." * draw.randint(3, 6)]
        )

    def prose() -> str:
        """Words behind a name and a colon or a sign that assign nothing: a sentence goes on."""
        return draw.choice([str.lower, str.capitalize])("".join(draw.choice(words) for _ in range(draw.choice([1, 1, 1, 2]))))

    paths = ["", "src", "src/main.py", "config/prod.yml", "notes.txt", "tests/test_keys.py", "docs/example.md", "package-lock.json"]
    out = []
    for k in range(count):
        path = draw.choice(paths[:5] if draw.random() < 0.8 else paths)
        if k % 8 == 7:
            if draw.random() < 0.25:
                out.append((short_secret(), f"{around()} {draw.choice(['postgres', 'https', 'mysql', 'redis'])}://{draw.choice(words)}:", "@" + draw.choice(words), path, 1))
                continue
            before = f"{around()} {draw.choice(names + ['DB_PASS', 'pass'])}{draw.choice(signs)}"
            out.append((short_secret(), before, before[-1] if before[-1] in "\"'" else " ", path, 1))
        elif k % 8 == 6:
            before = f"{around()} {draw.choice(names + ['DB_PASS', 'pass'])}{draw.choice(signs)}"
            out.append((draw.choice([placeholder, placeholder, prose])(), before, before[-1] if before[-1] in "\"'" else " ", path, 0))
        elif k % 2:
            if draw.random() < 0.45:
                before, token = around() + draw.choice([" ", " ", ' "', "="]), draw.choice(makes)()
            else:
                before, token = f"{around()} {draw.choice(names)}{draw.choice(signs)}", draw.choice(assigned + makes)()
            after = draw.choice(['"', "'", " ", "", "\n"]) if before[-1] in "\"'" else " "
            out.append((token, before, before[-1] if before[-1] in "\"'" else after, path, 1))
        else:
            token, mark = draw.choice(harmless)()
            before = f"{around()} {mark}"
            out.append((token, before, draw.choice([" ", ".", ","]) + around(), path, 0))
    return [f for f in out if len(f[0]) >= (6 if f[1].rstrip("\"'` ")[-1:] in ("=", ":") else 12)]


def _grow(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int, nodes: list) -> int:
    """A tree over the rows, as [feature, threshold, left, right, share of label 1] entries; gini splits."""
    at, share = len(nodes), float(y.mean())
    nodes.append([-1, 0.0, 0, 0, share])
    if depth == 0 or share in (0.0, 1.0) or len(y) < 2 * LEAST:
        return at
    best = (len(y) * share * (1 - share) - 1e-9, None)
    for k in rng.choice(x.shape[1], 5, replace=False):
        order = np.argsort(x[:, k], kind="stable")
        v, t = x[order, k], np.cumsum(y[order])
        cut = np.flatnonzero(v[1:] != v[:-1])
        cut = cut[(cut + 1 >= LEAST) & (len(y) - cut - 1 >= LEAST)]
        if not len(cut):
            continue
        n, a = cut + 1.0, t[cut]
        m, b = len(y) - n, t[-1] - a
        cost = a * (n - a) / n + b * (m - b) / m
        i = int(cost.argmin())
        if cost[i] < best[0]:
            best = (cost[i], (int(k), float(v[cut[i]])))
    if best[1] is None:
        return at
    k, threshold = best[1]
    low = x[:, k] <= threshold
    nodes[at][:4] = [k, threshold, _grow(x[low], y[low], rng, depth - 1, nodes), _grow(x[~low], y[~low], rng, depth - 1, nodes)]
    return at


def fit(usual: Surroundings, findings: list[tuple[str, str, str, str, int]], seed: int = 5) -> SecretModel:
    """A forest of trees on bootstrap samples of the labelled findings."""
    x = np.array([describe(*f[:4], usual) for f in findings], float).reshape(-1, len(NAMES))
    y, rng, trees = np.array([f[4] for f in findings], float), np.random.default_rng(seed), []
    for _ in range(TREES if len(y) else 0):
        rows, nodes = rng.integers(0, len(y), len(y)), []
        _grow(x[rows], y[rows], rng, DEPTH, nodes)
        trees.append(tuple(np.array(c) for c in zip(*nodes, strict=True)))
    return SecretModel(usual, trees)


def probability(model: SecretModel, x: np.ndarray) -> np.ndarray:
    """Mean share of secrets in the leaves that the rows reach."""
    total = np.zeros(len(x))
    for feature, threshold, left, right, share in model.trees:
        at = np.zeros(len(x), dtype=np.int64)
        for _ in range(DEPTH):
            k = feature[at]
            go = np.where(x[np.arange(len(x)), k] <= threshold[at], left[at], right[at])
            at = np.where(k >= 0, go, at)
        total += share[at]
    return total / max(1, len(model.trees))


def learn(docs: DataFrame, findings: list[tuple[str, str, str, str, int]] | None = None) -> SecretModel:
    """A model from labelled findings and from the words and transitions that are usual in all whole texts.

    Findings are made by rule from words of at most about SOURCE_ROWS rows if none are given. Works without rows.
    """
    usual = usual_of(docs)
    if findings:
        return fit(usual, findings)
    rows = bounded(docs.select("doc_id", "text").where("text is not null"), "doc_id", SOURCE_ROWS)
    texts = sorted(r.text for r in rows.select(F.substring("text", 1, ROW_CHARS).alias("text")).collect())
    words = sorted({w for t in texts for w in _WORD.findall(t) if w.isascii()})
    return fit(usual, labelled_findings(words))


def find(model: SecretModel, texts: list[str | None], paths: list[str | None], threshold: float = THRESHOLD) -> list[list[tuple[int, str, float]]]:
    """Per text: (start, token, score) of the candidates that the forest takes for secrets."""
    owners, places, tokens, rows = [], [], [], []
    for i, (text, path) in enumerate(zip(texts, paths, strict=True)):
        for start, token in candidates(text or ""):
            owners.append(i)
            places.append(start)
            tokens.append(token)
            end = start + len(token)
            rows.append(describe(token, text[max(0, start - 64) : start], text[end : end + 16], path or "", model.usual))
    out: list[list] = [[] for _ in texts]
    scores = probability(model, np.array(rows, float).reshape(-1, len(NAMES)))
    for i, start, token, score in zip(owners, places, tokens, scores.tolist(), strict=True):
        if score >= threshold:
            out[i].append((start, token, score))
    return out


def _path(docs: DataFrame, path: str | None):
    return F.col(path).cast("string").alias("path") if path in docs.columns else F.lit("").alias("path")


def scan(docs: DataFrame, model: SecretModel, path: str | None = "source", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, start, length (code points), secret, score: a row per secret found in any row's whole text.

    Null and empty texts hold none; a null or missing path counts as empty; a null doc_id is kept.
    Repeated rows give repeated findings; other columns are ignored. No shuffle.
    """

    def run(batches):
        for batch in by_bytes(batches):
            ids, texts, paths = (batch.column(i).to_pylist() for i in range(3))
            rows = [(i, s, len(t), t, p) for i, found in zip(ids, find(model, texts, paths, threshold), strict=True) for s, t, p in found]
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.float64())
            names = ("doc_id", "start", "length", "secret", "score")
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    rows = docs.select(F.col("doc_id").cast("long"), "text", _path(docs, path))
    return arrow_map(rows, run, "doc_id long, start int, length int, secret string, score double")


def redact(docs: DataFrame, model: SecretModel, path: str | None = "source", threshold: float = THRESHOLD) -> DataFrame:
    """The same rows and columns with each secret in ``text`` replaced by MASK; a null text stays null."""

    def run(batches):
        for batch in by_bytes(batches):
            texts, out = batch.column("text").to_pylist(), []
            for t, found in zip(texts, find(model, texts, batch.column(_PATH).to_pylist(), threshold), strict=True):
                for start, token, _ in reversed(found):
                    t = t[:start] + MASK + t[start + len(token) :]
                out.append(t)
            columns = [pa.array(out, pa.string()) if name == "text" else batch.column(name) for name in names]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    names = docs.columns
    fields = [T.StructField(f.name, T.StringType()) if f.name == "text" else f for f in docs.schema.fields]
    return arrow_map(docs.select("*", _path(docs, path).alias(_PATH)), run, T.StructType(fields))
