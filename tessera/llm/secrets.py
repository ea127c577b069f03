"""Secret scan with a random forest against false positives.

Candidates are passwords of credentials (user:password@host), values of 6 or more characters behind a secret word, `=` or
`:` (quoted, or up to a space or separator) and runs of 16 or more key characters, wherever they stand; a
name before `=` is no part of its value. Of overlapping findings the one with the best score counts. Each has features of its length and character classes,
class changes and letter-pair surprise (character transitions), the share covered by dictionary words, whether it stands
in a path or address, and the words before and behind it. A random forest in numpy (bootstrap, Gini, a random subset of
features a split), trained from labelled findings, gives its probability. Labelled findings are (text, start, end,
label) rows; the default ones are generated from a fixed seed: keys and tokens in settings against card numbers,
checksums, commit ids, UUIDs, slugs, paths and placeholders.

Cases: null or empty text has no candidate; whole texts are scanned, and only a fixed window beside a candidate is read
for its neighbours; equal secrets in one document are one row each; null ids are carried; an empty table gives an empty
result; other columns stay out.
"""

from __future__ import annotations

import base64
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import slices, small_batches, table

CANDIDATE = re.compile(rb"[A-Za-z0-9_+/.\-]{16,}+(?:={1,2}+(?![A-Za-z0-9_+/.=\-]))?")
# Fixed word lists: words of settings that hold secrets, words beside harmless identifiers, dictionary words.
SECRET_WORDS = ("token", "secret", "password", "passwd", "pwd", "key", "apikey", "auth", "bearer", "credential", "private", "access")
HARMLESS_WORDS = ("commit", "sha", "sha1", "sha256", "md5", "checksum", "digest", "hash", "uuid", "guid", "id", "order", "invoice", "version", "build", "card", "phone", "isbn", "example", "revision", "etag")
DICTIONARY = ("about", "access", "account", "action", "address", "after", "agent", "article", "assets", "author", "blog", "book", "build", "cache", "case", "change", "chart", "check", "city", "class", "client", "code", "common", "config", "content", "core", "data", "date", "default", "design", "docs", "download", "draft", "email", "event", "example", "file", "final", "first", "form", "from", "global", "group", "guide", "help", "home", "house", "html", "image", "index", "info", "item", "java", "json", "key", "lang", "last", "latest", "layer", "line", "link", "list", "local", "main", "make", "master", "media", "model", "module", "month", "name", "news", "node", "note", "order", "page", "part", "path", "photo", "place", "plan", "point", "post", "price", "product", "project", "public", "python", "query", "read", "release", "report", "review", "sample", "school", "search", "server", "service", "session", "site", "source", "spring", "start", "state", "story", "string", "style", "summer", "system", "table", "task", "team", "temp", "test", "text", "time", "title", "token", "type", "update", "user", "value", "version", "video", "view", "week", "window", "winter", "word", "work", "world", "year", "your")
WORDS = re.compile(r"[a-z0-9]+")
# `&` ends a value only where the next name of a query follows; values of over 1,023 bytes are left to CANDIDATE, which has no limit
VALUE = rb"""(?:"(?P<a>[^"\s]{6,1024}+)"|'(?P<b>[^'\s]{6,1024}+)'|`(?P<c>[^`\s]{6,1024}+)`|["'`]?(?P<d>(?:[^\s"'`<>(){}\[\],;&]|&(?![\w.\-]{1,64}+=)){1,1024}+))"""
ASSIGNED = re.compile(rb"""(?i)(?:[=:]>?|(?:%s)s?["'`]?(?:[ \t]+(?:is|was|=|:))?(?=[\s"'`]))[ \t]*(?=(?P<value>%s))""" % ("|".join(SECRET_WORDS).encode(), VALUE))
CREDENTIAL = re.compile(rb"""(?<![\w.%+\-])[\w.%+\-]*+:(?=([^\s"'`<>/]{4,1024})@[\w\[])""")
PAIRS = np.zeros((27, 27))
for _w in DICTIONARY:
    for _a, _b in zip(_w, _w[1:], strict=False):
        PAIRS[ord(_a) - 97, ord(_b) - 97] += 1
PAIRS = -np.log2((PAIRS + 0.1) / (PAIRS + 0.1).sum(axis=1, keepdims=True))
NEAR = 48  # bytes beside a candidate


def features(value: str, before: str, after: str) -> list[float]:
    n = len(value)
    kinds = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "s" for c in value]
    share = {k: kinds.count(k) / n for k in "duls"}
    changes = sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / max(1, n - 1)
    low = value.lower()
    letters = [(ord(a) - 97, ord(b) - 97) for a, b in zip(low, low[1:], strict=False) if "a" <= a <= "z" and "a" <= b <= "z"]
    surprise = float(np.mean([PAIRS[a, b] for a, b in letters])) if letters else 8.0
    covered, at = 0, 0
    while at < n:
        hit = next((k for k in (8, 7, 6, 5, 4) if low[at : at + k] in WORDSET and at + k <= n), 0)
        covered += hit
        at += hit or 1
    counts = np.unique(list(value), return_counts=True)[1] / n
    entropy = float(-(counts * np.log2(counts)).sum())
    prior, later = WORDS.findall(before.lower())[-3:], WORDS.findall(after.lower())[:2]
    tail = before.rstrip(" \"'`")[-1:]
    return [
        n, share["d"], share["u"], share["l"], share["s"], changes, surprise, covered / n, entropy, float(bool(re.fullmatch("[0-9a-f]+|[0-9A-F]+", value))),
        float(tail == "/" or value.count("/") > 1 or "://" in before[-24:]), float(value.count("-") + value.count("_") + value.count(".")), float(tail in ("=", ":")),
        float(any(w in SECRET_WORDS or w.endswith(("key", "token", "secret")) for w in prior)), float(any(w in HARMLESS_WORDS for w in prior + later)), float(before[-1:] in "\"'`" and before[-1:] != ""),
        float(after[:1] == "@" and before[-1:] == ":"), float(bool(prior) and any(prior[-1].endswith(w) for w in SECRET_WORDS)), float(bool(re.search("[^0-9A-Za-z]", value[1:-1]))), float(value.isalpha() and value[1:] == value[1:].lower()),
    ]


WORDSET = frozenset(DICTIONARY)


def candidates(t: bytes) -> list[tuple[int, int]]:
    """Byte spans of a text, one for each start: a credential's password, else a value, else a run of key characters."""
    found: dict[int, int] = {}
    for m in CANDIDATE.finditer(t):
        a, b = m.span()
        while b > a and t[b - 1] in b".-":
            b -= 1
        if b - a >= 16:
            found[a] = b
    for m in ASSIGNED.finditer(t):
        a, b = next(m.span(k) for k in "abcd" if m[k] is not None)
        while m["d"] is not None and b > a and t[b - 1] in b".:":
            b -= 1
        if 6 <= b - a < 1024 and not t.startswith(b"//", a):
            found[a] = b
    found |= (m.span(1) for m in CREDENTIAL.finditer(t) if not t.startswith(b"//", m.start(1)))
    return sorted(found.items())


def labelled(n: int = 4800, seed: int = 11) -> list[tuple[str, int, int, int]]:
    """Generated findings (text, start, end, label)."""
    r = random.Random(seed)
    pick = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    hexa, alnum = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    word = lambda: pick("etaoinshrdlucmfwyp", r.randint(2, 9))
    prose = lambda: " ".join(word() for _ in range(r.randint(2, 6)))
    out = []
    for k in range(n):
        good, tail = k % 2, None
        if k % 4 == 3:
            letters, signs = alnum[:52], "!@#$%&*_-+:?"
            value = r.choice([lambda: pick(alnum, r.randint(8, 15)), lambda: pick(alnum + signs, r.randint(8, 20)) + r.choice("!#$%*7a"), lambda: pick(letters, r.randint(12, 40)), lambda: pick(letters[26:], r.randint(16, 40)),
                              lambda: word().capitalize() + word() + r.choice(signs) + pick("0123456789", r.randint(1, 4)), lambda: word() + pick("0123456789", r.randint(2, 5)) + r.choice(("", "!", "#", "$"))])()
            name = r.choice(("token", "api_key", "secret", "password", "passwd", "pwd", "DB_PASSWORD", "SECRET_KEY", "client_secret", "Password"))
            head = r.choice((f'{name} = "', f"{name}: ", f"{name}='", f'"{name}": "', f"{name}=", f"{name} = ", f"{name} is "))
            if len(value) < 8:
                value += pick(alnum, 8 - len(value))
            if r.random() < 0.3:
                head, tail = r.choice(("postgres", "mysql", "https", "amqp", "redis", "ftp")) + f"://{word()}:", f"@{word()}.example.com{r.choice(('', '/' + word(), ':5432/' + word()))} {prose()}"
        elif k % 4 == 2:
            name = r.choice(("note", "name", "see", "type", "class", "lang", "title", "value", "status", "level", "http", "result", word(), word()))
            secret = r.choice(("token", "api_key", "secret", "password", "key", "auth", "PASSWORD"))
            common = lambda: r.choice((word() + word(), r.choice(DICTIONARY) + "s", word() + r.choice(DICTIONARY), (word() + word()).capitalize()))
            value, head = r.choice([
                lambda: (common() + "es", f"{name}{r.choice((': ', '=', ' = ', ':'))}{r.choice(('', chr(34)))}"),
                lambda: (r.choice(DICTIONARY) + r.choice("_-.") + common(), f"{name}{r.choice((': ', '=', ' = '))}{r.choice(('', chr(34)))}"),
                lambda: (common() + "en", r.choice(("the key ", "a token ", "access ", "private ", "secret ", "the password ", "keys ", "tokens "))),
                lambda: (r.choice(("your_password", "your-api-key", "example_key", "xxxxxxxx", "********", "${TOKEN}", "$PASSWORD", "process.env.API_KEY", "os.environ", "undefined", "required", "string", "changeme", "password", "optional")), f"{secret}{r.choice((': ', '=', ' = '))}{r.choice(('', chr(34)))}"),
                lambda: (r.choice((f"{r.randint(10, 23)}:{r.randint(10, 59)}:{r.randint(10, 59)}", f"{r.randint(1990, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}", str(r.randint(100_000, 10**9)), f"{r.randint(1, 999)},{r.randint(100, 999)}"[:9] + ".00", f"v{r.randint(1, 20)}.{r.randint(1, 20)}.{r.randint(1, 20)}", f"localhost:{r.randint(1000, 9999)}")), f"{r.choice(('date', 'time', 'at', 'total', 'host', 'port', name))}{r.choice((': ', '=', ' = '))}"),
                lambda: (r.choice((word() + word() + "enterprises", r.choice("-/._").join(r.choice(DICTIONARY) for _ in range(5)), "-" * 20, "." * 18, ("_".join(r.choice(DICTIONARY) for _ in range(4))).upper(), (word() + word() + "ennungen").upper())), r.choice(("", "see ", "/", "the "))),
                lambda: ("/" + "/".join(r.choice(DICTIONARY) for _ in range(r.randint(2, 4))), f'{r.choice(("href", "src", "path", "file"))}{r.choice(("=", ": "))}{r.choice(("", chr(34)))}'),
            ])()
            if r.random() < 0.1:
                value, head, tail = word() + word(), "mailto:", f"@{word()}.example.com {prose()}"
        elif good:
            value = r.choice([lambda: pick(hexa, r.choice((32, 40, 48, 64))), lambda: pick(alnum, r.randint(20, 64)), lambda: base64.b64encode(r.randbytes(r.randint(16, 48))).decode(), lambda: "sk_live_" + pick(alnum, 24), lambda: "AKIA" + pick(alnum[:26] + alnum[52:], 16)])()
            name = r.choice(("token", "api_key", "secret", "password", "auth_token", "access_key", "client_secret", "TOKEN"))
            head = r.choice((f'{name} = "', f"{name}: ", f"{name}='", f'"{name}": "', f"{name}="))
            if r.random() < 0.1:
                head = "Bearer "
            elif value.startswith(("AKIA", "sk_live_")) and r.random() < 0.6:
                head = ""
        else:
            value, head = r.choice([
                lambda: (pick("0123456789", r.choice((16, 16, 19))), r.choice(("", "card ", "order ", "no. "))),
                lambda: (pick(hexa, r.choice((32, 40, 64))), r.choice(("commit ", "sha1: ", "md5 ", "checksum = ", "sha256:", "etag ", "revision "))),
                lambda: ("-".join(pick(hexa, m) for m in (8, 4, 4, 4, 12)), r.choice(("uuid ", "id: ", "guid=", ""))),
                lambda: ("-".join(r.choice(DICTIONARY) for _ in range(r.randint(3, 6))) + f"-{r.randint(1, 2025)}", r.choice(("", "https://site.example.com/blog/", "/posts/"))),
                lambda: ("/".join(r.choice(DICTIONARY) for _ in range(r.randint(3, 5))) + f"/{r.randint(1, 99)}.html", r.choice(("", "/", "http://www.example.org/"))),
                lambda: ("xxxxxxxxxxxx" + pick("x0123", 8), r.choice(('token = "', "password: ", "key=", "example "))),
                lambda: (f"{r.randint(2000, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}T{r.randint(10, 23)}.{r.randint(10, 59)}.{r.randint(10, 59)}", ""),
                lambda: (f"{word()}.{word()}{r.randint(1, 99)}-{word()}.example.com", r.choice(("mail ", "from "))),
            ])()
        left, right = f"{prose()} {head}", f'{chr(34) if chr(34) in head[-1:] else ""} {prose()}' if tail is None else tail
        out.append((left + value + right, len(left), len(left) + len(value), good))
    return out


class Forest:
    """Random forest of axis splits; nodes in arrays: feature (-1 at a leaf), cut, left, right, share."""

    def __init__(self, trees: list[np.ndarray]):
        self.trees = trees

    def predict(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for t in self.trees:
            at = np.zeros(len(x), np.int64)
            while True:
                f = t[at, 0].astype(np.int64)
                inner = f >= 0
                if not inner.any():
                    break
                right = x[np.arange(len(x)), np.maximum(f, 0)] > t[at, 1]
                at = np.where(inner, np.where(right, t[at, 3], t[at, 2]).astype(np.int64), at)
            total += t[at, 4]
        return total / max(1, len(self.trees))


def grow(x: np.ndarray, y: np.ndarray, trees: int = 30, depth: int = 8, least: int = 3, seed: int = 1) -> Forest:
    rng = np.random.default_rng(seed)
    some = max(1, int(x.shape[1] ** 0.5))
    out = []
    for _ in range(trees):
        nodes: list[list[float]] = []

        def split(rows: np.ndarray, level: int, nodes: list[list[float]] = nodes) -> int:
            me, share = len(nodes), float(y[rows].mean())
            nodes.append([-1, 0, 0, 0, share])
            if level == depth or len(rows) < 2 * least or share in (0.0, 1.0):
                return me
            best = (share * (1 - share) * len(rows) - 1e-9, -1, 0.0)
            for f in rng.permutation(x.shape[1])[:some]:
                order = rows[np.argsort(x[rows, f], kind="stable")]
                v, ones = x[order, f], np.cumsum(y[order])
                k = np.arange(1, len(order))
                ok = (v[1:] > v[:-1]) & (k >= least) & (len(order) - k >= least)
                if not ok.any():
                    continue
                left, right = ones[:-1] / k, (ones[-1] - ones[:-1]) / (len(order) - k)
                cost = np.where(ok, left * (1 - left) * k + right * (1 - right) * (len(order) - k), np.inf)
                i = int(cost.argmin())
                if cost[i] < best[0]:
                    best = (float(cost[i]), int(f), float((v[i] + v[i + 1]) / 2))
            if best[1] >= 0:
                high = x[rows, best[1]] > best[2]
                nodes[me][:2] = [best[1], best[2]]
                nodes[me][2], nodes[me][3] = split(rows[~high], level + 1), split(rows[high], level + 1)
            return me

        split(rng.integers(0, len(y), len(y)), 0)
        out.append(np.array(nodes))
    return Forest(out)


def train(findings: list[tuple[str, int, int, int]], **options) -> Forest:
    x = np.array([features(t[a:b], t[max(0, a - NEAR) : a], t[b : b + NEAR]) for t, a, b, _ in findings])
    return grow(x, np.array([k for *_, k in findings], float), **options)


def scan(docs: DataFrame, forest: Forest, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start int, end int in characters, score double) of every finding with that score."""
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, text_col):
                places, rows = [], []
                for i, t in enumerate(texts):
                    for a, b in candidates(t or b""):
                        before, after = t[max(0, a - NEAR) : a].decode(errors="ignore"), t[b : b + NEAR].decode(errors="ignore")
                        rows.append(features(t[a:b].decode(errors="ignore"), before, after))
                        places.append((i, a, b))
                if not rows:
                    continue
                score = forest.predict(np.array(rows))
                ids, out, taken = part.column(0), [], {}
                for (i, a, b), s in sorted(zip(places, score, strict=True), key=lambda x: (-x[1], x[0][1] - x[0][2], x[0])):
                    if s >= least and all(b <= x or y <= a for x, y in taken.get(i, ())):
                        taken.setdefault(i, []).append((a, b))
                        at = len(texts[i][:a].decode(errors="ignore"))
                        out.append((ids[i].as_py(), at, at + len(texts[i][a:b].decode(errors="ignore")), round(float(s), 6)))
                if out:
                    kinds = (ids.type, pa.int32(), pa.int32(), pa.float64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], [id_col, "start", "end", "score"])

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, start int, end int, score double")


def op8_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"), train(labelled()))
