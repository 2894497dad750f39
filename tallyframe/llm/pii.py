"""Personal data: exact base patterns, and looser candidates that boosted trees accept or reject."""

from __future__ import annotations

import bisect
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .boosting import BoostedTrees

#: Kinds with a base pattern, in the order in which spans are listed, and one that only the method finds.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")
Span = tuple[int, int]

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_SET = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str, mark: re.Pattern) -> list[Span]:
    """Matches around each mark: the run of local characters left of it, not before the last match's end.

    A local part holds no mark, so this finds what the whole pattern finds leftmost, in time linear in the text.
    """
    found, end = [], 0
    for m in mark.finditer(text):
        start = m.start()
        while start > end and text[start - 1] in _LOCAL_SET:
            start -= 1
        if start < m.start():
            found.append((start, m.end()))
            end = m.end()
    return found


def base_spans(text: str) -> dict[str, list[Span]]:
    """Spans of each kind by the fixed patterns: leftmost, non-overlapping; matches that fail their check are dropped."""
    out: dict[str, list[Span]] = {k: [] for k in BASE_KINDS}
    if "@" in text:
        out["email"] = _emails(text, _DOMAIN)
    if "." in text:
        out["ip"] = [m.span() for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
    out["card"] = [m.span() for m in _DIGITS.finditer(text) if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m.group())) <= 19 and luhn(d)]
    if "+" in text:
        out["phone"] = [m.span() for m in _PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    return out


#: Words before a number that hint at its kind.
CUES = {
    "email": ("mail", "contact", "write", "address", "reach"),
    "ip": ("ip", "host", "server", "address", "node"),
    "card": ("card", "visa", "credit", "debit", "payment", "account"),
    "phone": ("phone", "tel", "call", "mobile", "cell", "fax", "dial"),
    "secret": ("token", "key", "secret", "password", "passwd", "pwd", "auth", "bearer", "credential"),
}
AGAINST = ("version", "order", "invoice", "isbn", "id", "no", "page", "section", "fig", "build", "total", "date", "ref", "commit", "sha", "md5", "checksum", "digest", "hash", "file", "uuid", "tracking", "serial")
#: Beginnings of keys that services give out.
PREFIXES = ("sk-", "pk-", "ghp_", "gho_", "xoxb-", "xoxp-", "AKIA", "ASIA", "AIza", "eyJ", "glpat-")

_SIGN = re.compile(r"[\[({][Aa][Tt][\])}]")
_AT = re.compile(r"\s?(?:\[at\]|\(at\)|\{at\})\s?[A-Za-z0-9-]+(?:\s?(?:\[dot\]|\(dot\)|\{dot\}|\.)\s?[A-Za-z0-9-]+)+", re.I)
_NUMBER = re.compile(r"\(?(?<![0-9A-Za-z])[0-9](?:[\x20().-]{0,2}[0-9])+")
_GROUP = re.compile(r"[0-9]+")
_CUT_LEFT, _CUT_RIGHT = re.compile(r"[0-9]([\x20().-]{1,2})\Z"), re.compile(r"([\x20().-]{1,2})[0-9]")
_LONG = re.compile(r"[A-Za-z0-9+/_=.-]{16,}")
_TRIM = "=.-_/+"
_NAMED = re.compile(r"(?:token|key|secret|passw(?:or)?d|pwd|auth|bearer|credential)s?[A-Za-z0-9_-]{0,20}[\"']?\s?(?:[:=]{1,2}>?|\s)\s?[\"']?([^\s\"',;<>(){}\[\]|]{6,})", re.I)
_IP6 = re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])")


def _secrets(text: str) -> list[Span]:
    """Long runs of letters and digits mixed, and what stands behind a word for a key."""
    found = set()
    for m in _LONG.finditer(text):
        run = m.group().strip(_TRIM)
        if len(run) >= 16 and not run.isalpha() and not run.isdigit() and any(map(str.isdigit, run)):
            start = m.start() + m.group().index(run)
            found.add((start, start + len(run)))
    low = text.lower()
    if any(w in low for w in CUES["secret"]):
        for m in _NAMED.finditer(text):
            start, end = m.span(1)
            while end > start and text[end - 1] in ".:!?*#$%&=":
                end -= 1
            if end - start >= 6 and any(map(str.isdigit, text[start:end])):
                found.add((start, end))
    return sorted(found)


def candidates(text: str) -> list[tuple[str, int, int]]:
    """Overlapping proposals: e-mail addresses that spell out the sign, long IP addresses, numbers with separators as card and as phone, keys and tokens as secrets.

    Numbers may stand next to each other, so of a run of groups of digits each stretch of whole groups is proposed that has
    a number's count of digits: at most 19 stretches a group.
    """
    found = [("secret", *s) for s in _secrets(text)]
    if _SIGN.search(text):
        found += [("email", *s) for s in _emails(text, _AT)]
    if text.count(":") >= 7:
        found += [("ip", *m.span()) for m in _IP6.finditer(text)]
    for m in _NUMBER.finditer(text):
        if m.end() - m.start() >= 7:
            groups = [g.span() for g in _GROUP.finditer(text, *m.span())]
            for k, (start, _) in enumerate(groups):
                before, n = text[start - 1 : start] if start else "", 0
                if before == "(":
                    start, before = start - 1, text[start - 2 : start - 1] if start > 1 else ""
                for first, end in groups[k:]:
                    n += end - first
                    if n > 19:
                        break
                    if 7 <= n <= 15:
                        found.append(("phone", start - (before == "+"), end))
                    if n >= 13:
                        found.append(("card", start, end))
    return found


def _cut(m: re.Match | None) -> float:
    """0 if digits end there, 1 if more follow behind a blank, 2 behind another separator."""
    return 0.0 if m is None else 1.0 if m.group(1)[:1] == " " else 2.0


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    """Format of the span and its surroundings, as numbers."""
    span, before, after = text[start:end], text[max(0, start - 28) : start].lower(), text[end : end + 1]
    words = re.findall(r"[a-z]+|[0-9]+", before)[-3:]
    groups = [len(g) for g in _GROUP.findall(span)]
    digits = _digits(span)
    letters, upper = sum(map(str.isalpha, span)), sum(map(str.isupper, span))
    return [
        float(KINDS.index(kind)), float(len(digits)), float(end - start), float(len(groups)), float(max(groups, default=0)), float(groups[-1] if groups else 0), float(groups[0] if groups else 0),
        float(span.count("-")), float(span.count(".")), float(span.count(" ")), float(span.count("(")), float(luhn(digits)) if digits else 0.0,
        float(any(w in CUES[kind] for w in words)), float(any(w in AGAINST for w in words)), float(text[start - 1 : start] in "+#$€/=_" and start > 0), float(after.isalnum() or after in ("%", "/", "_")), float(span.count(":")),
        _cut(_CUT_LEFT.search(text[max(0, start - 3) : start])), _cut(_CUT_RIGHT.match(text, end)), float(span[:1] == "+"),
        letters / (end - start), upper / max(1, letters), len(set(span)) / (end - start), float(span.count("/") + span.count("_")), float(span.startswith(PREFIXES)), float(bool(re.search(r"[:=][\s\"']*\Z", before))), float(before[-1:] in ("\"", "'")), float(all(c in "0123456789abcdefABCDEF" for c in span)),
    ]


def _luhn_card(r: random.Random, n) -> str:
    d = r.choice("3456") + n(14)
    return next(d + c for c in "0123456789" if luhn(d + c))


def _secret(r: random.Random, n, y: int) -> str:
    pick = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    hexa, mixed = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    word = lambda: pick("abdeilnorstu", r.randint(3, 8))
    if y:
        made = r.choice((pick(hexa, r.choice((32, 40, 40, 48, 64))), pick(mixed, r.randint(20, 64)), r.choice(PREFIXES) + pick(mixed, r.randint(16, 40)), pick(mixed + "-_", r.randint(24, 40)), pick(mixed + "!#%", r.randint(8, 16)), f"{word()}{n(r.randint(1, 4))}{word()}{n(r.randint(0, 2))}"))
        return made.upper() if r.random() < 0.15 else made
    return r.choice((f"{word()}_{word()}_{word()}{n(2)}", f"{word()}-{word()}-{word()}-{n(2)}", f"{word()}/{word()}/{word()}{n(1)}.html", f"{n(4)}-{n(2)}-{n(2)}T{n(2)}.{n(2)}.{n(2)}Z", f"{word()}{word()}{word()}{n(1)}", pick(hexa, r.choice((32, 40, 64))), f"{word()}.{word()}.{word()}.v{n(1)}.{n(1)}"))


#: What stands around made-up spans where no text is known: words of these letters.
LETTERS = "abdeilnorstu"


class Context:
    """Stretches of real texts, free of base spans, to put made-up spans into; words of random letters where there are none."""

    def __init__(self, stretches: list[str], r: random.Random):
        self.stretches, self.r = stretches, r

    def words(self) -> str:
        r = self.r
        if self.stretches and r.random() < 0.8:
            found = r.choice(self.stretches).split()
            if found:
                at = r.randrange(len(found))
                return " ".join(found[at : at + r.randint(1, 5)])
        return " ".join("".join(r.choice(LETTERS) for _ in range(r.randint(2, 9))) for _ in range(r.randint(1, 4)))


def _example(r: random.Random, context: Context) -> tuple[str, str, int, int, int]:
    """A made-up span in a context: text, kind, start, end, whether it is personal or secret."""
    n = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice(LETTERS) for _ in range(r.randint(2, 9)))
    kind, y = r.choice(KINDS), int(r.random() < 0.5)
    cue = ""
    if r.random() < (0.5 if y else 0.1):
        cue = r.choice(CUES[kind])
    elif not y and r.random() < 0.6:
        cue = r.choice(AGAINST)
    mark = r.choice((":", " is", "", ""))
    if kind == "email":
        at, dot = r.choice(("[at]", "(at)", " [at] ")), r.choice(("[dot]", ".", " (dot) "))
        span = f"{word()}{at}{word()}{dot}{r.choice(('com', 'org', 'net'))}" if y else f"{word()}(at){n(2)}.{n(1)}"
    elif kind == "ip":
        span = ":".join("".join(r.choice("0123456789abcdef") for _ in range(r.randint(1, 4) if y else 2)) for _ in range(8))
    elif kind == "card":
        # one digit may be mistyped; a run of sixteen digits that fails the check digit is an account's only where a word says so, and any number otherwise
        d = _luhn_card(r, n) if r.random() < 0.5 else n(16)
        plain = r.random() < 0.3
        if y:
            span = ("" if plain else r.choice((" ", "-", "."))).join(d[k : k + 4] for k in range(0, 16, 4))
            if plain and not luhn(d):
                cue = r.choice(CUES["card"])
        else:
            span = n(16) if plain else r.choice((n(13), n(14), n(17), n(18), n(19), f"{n(6)}.{n(8)}", f"{n(4)} {n(4)} {n(3)} {n(4)}"))
            cue = "" if plain and cue in CUES["card"] else cue
    elif kind == "phone":
        a, b, c = n(3), n(3), n(4)
        span = r.choice((f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}")) if y else r.choice((n(7), n(8), n(9), n(10), f"{n(4)}-{n(2)}-{n(2)}", f"{n(1)}.{n(3)}.{n(4)}", f"{n(3)} {n(2)} {n(3)} {n(1)}", f"{n(2)}.{n(2)}.{n(4)}"))
        if not y and r.random() < 0.3:  # the start of a word of letters and digits
            left = f'{context.words()} {r.choice(("", cue, "token ="))} "'
            return f"{left}{n(r.randint(7, 12))}{r.choice('abcdef')}{n(3)}d{n(2)} {context.words()}", kind, len(left), len(left) + 7, 0
    else:
        span = _secret(r, n, y)
        named = y or r.random() < 0.15
        if not y and len(span) >= 32 and span.isalnum():  # a checksum looks like a key: what it is called tells them apart
            cue, named = r.choice(AGAINST[-11:-4]), False
        elif y and (len(span) < 20 or cue not in CUES["secret"]) and not span.startswith(PREFIXES):
            cue = r.choice(CUES["secret"])
        if named and cue in CUES["secret"]:
            mark = r.choice((" =", "=", ":", ": ", " = "))
        quote = r.choice(("", '"', "'"))
        left = f"{context.words()} {cue.upper() if r.random() < 0.1 else cue}{mark}{'' if mark.endswith('=') and r.random() < 0.5 else ' '}{quote}"
        return f"{left}{span}{quote} {context.words()}", kind, len(left), len(left) + len(span), y
    left = f"{context.words()} {cue}{mark if cue else ''} ".replace("  ", " ")
    return f"{left}{span}{r.choice(('', '', ',', '.', '!!'))} {context.words()}", kind, len(left), len(left) + len(span), y


def _neighbours(r: random.Random, context: Context) -> list[tuple[str, str, int, int, int]]:
    """Numbers next to each other in a context, personal and others: all their candidates, as in ``_example``."""
    n = lambda k: "".join(r.choice("0123456789") for _ in range(k))

    def one() -> tuple[str, str]:
        kind = r.choice(("phone", "phone", "card", "ip", ""))
        if kind == "phone":
            a, b, c = n(3), n(3), n(4)
            if r.random() < 0.2:
                return kind, f"+{n(2)} {n(2)} {n(4)} {n(4)}"
            return kind, r.choice(("", "", "+1 ", f"+{n(2)} ", "1-")) + r.choice((f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}"))
        if kind == "card":
            d, mark = _luhn_card(r, n) if r.random() < 0.5 else n(16), r.choice((" ", "-", ".", ""))
            return kind if mark or luhn(d) else "", mark.join(d[k : k + 4] for k in range(0, 16, 4))
        if kind == "ip":
            return "", ".".join(str(r.randint(0, 255)) for _ in range(4))
        return "", r.choice((n(2), n(1), n(4), f"{n(2)}/{n(2)}", f"{n(4)}-{n(2)}-{n(2)}", f"{n(4)} {n(4)} {n(3)} {n(4)}", f"{n(3)} {n(2)} {n(3)} {n(1)}", " ".join(n(r.randint(1, 4)) for _ in range(r.randint(3, 9)))))

    numbers = [one() for _ in range(r.randint(2, 3))]
    cues = [w for k, _ in numbers if k for w in CUES[k]]
    cue = r.choice(cues) + r.choice((":", " is", "")) if cues and r.random() < 0.4 else ""
    text, true = f"{context.words()} {cue} ".replace("  ", " "), set()
    for k, number in numbers:
        true.add((k, len(text), len(text) + len(number)))
        text += f"{number} "
    text += context.words()
    taken = Taken([s for v in base_spans(text).values() for s in v])
    return [(text, *c, int(c in true)) for c in candidates(text) if not taken.meets(*c[1:])]


def stretches(docs: DataFrame, id_col: str, text_col: str, sample: int, each: int = 4, width: int = 90) -> list[str]:
    """Stretches of ``sample`` documents (those of the smallest hash of the id and text): ``each`` of ``width`` code points at places spread over the whole text, without digits and signs of base spans."""
    text = F.col(text_col)
    step = F.floor((F.length(text) - width) / each)
    parts = F.transform(F.sequence(F.lit(0), F.lit(each - 1)), lambda k: text.substr((F.greatest(F.lit(0), step * k) + 1).cast("int"), F.lit(width)))
    # only the short parts are ordered and sent
    picked = docs.where(F.length(text) > 0).select(F.xxhash64(id_col, text_col).alias("o"), parts.alias("parts")).orderBy("o", "parts").limit(sample)
    return sorted(r[0] for r in picked.select(F.explode("parts").alias("part")).select(F.regexp_replace("part", "[0-9@]", "")).collect())  # sample * each of them


def train(known: list[str] | None = None, examples: int = 4000, seed: int = 5, precision: float = 0.98) -> tuple[BoostedTrees, list[float]]:
    """Trees and, for each kind, the lowest probability at which held-out examples have this precision.

    No labels of personal data exist, so spans and their counterparts are made up and put into ``known`` stretches of documents. The trees
    learn from one half of the stretches, the thresholds are calibrated on the other.
    """
    r = random.Random(seed)
    known = sorted(s for s in known or [] if not candidates(s))  # what may be personal itself has no label
    r.shuffle(known)
    half = len(known) // 2

    def made(context: Context) -> tuple[np.ndarray, np.ndarray]:
        found = [_example(r, context) for _ in range(examples // 2)]
        for _ in range(examples // 8):
            found += _neighbours(r, context)
        return np.array([features(*e[:4]) for e in found]), np.array([e[4] for e in found], dtype=float)

    trees = BoostedTrees(trees=80).fit(*made(Context(known[:half], r)))
    x, held = made(Context(known[half:], r))
    p, k = trees.probability(x), x[:, 0]
    limits = []
    for kind in range(len(KINDS)):
        own = np.sort(np.unique(p[k == kind]))
        good = [c for c in own if held[(k == kind) & (p >= c)].mean() >= precision]
        limits.append(float(max(0.5, min(good, default=1.1))))
    return trees, limits


class Taken:
    """Disjoint stretches of a text, kept in order."""

    def __init__(self, spans: list[Span]):
        self.starts, self.ends = [], []
        for s, e in sorted(spans):
            if self.ends and s < self.ends[-1]:
                self.ends[-1] = max(e, self.ends[-1])
            else:
                self.starts.append(s)
                self.ends.append(e)

    def meets(self, start: int, end: int) -> bool:
        k = bisect.bisect_right(self.ends, start)
        return k < len(self.starts) and self.starts[k] < end

    def add(self, start: int, end: int) -> None:
        k = bisect.bisect_left(self.starts, start)
        self.starts.insert(k, start)
        self.ends.insert(k, end)


def all_spans(text: str, base: dict[str, list[Span]], trees: BoostedTrees, limits: list[float]) -> dict[str, list[Span]]:
    """Base spans and the accepted candidates that overlap none of them; of overlapping ones the likelier stays."""
    out = {k: list(base.get(k, ())) for k in KINDS}
    taken = Taken([s for v in base.values() for s in v])
    proposed = [c for c in candidates(text) if not taken.meets(*c[1:])]
    if proposed:
        p = trees.probability(np.array([features(text, *c) for c in proposed]))
        for q, (kind, start, end) in sorted(zip(p.tolist(), proposed, strict=True), key=lambda c: (-c[0], c[1][1], -c[1][2])):
            if q >= limits[KINDS.index(kind)] and not taken.meets(start, end):
                out[kind].append((start, end))
                taken.add(start, end)
    return out


def joined(spans: dict[str, list[Span]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k in KINDS for s, e in sorted(spans.get(k, ())))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", redact: bool = False, sample: int = 500) -> DataFrame:
    """Personal data and secrets of each row: id, base spans, all spans, and with ``redact`` the text with each span as its kind in brackets.

    Returns ``base`` and ``spans`` as text ``kind:start:end`` (code points, end exclusive), joined by commas in
    order of kind and start, the numbers of base spans ``n_email`` to ``n_phone``, and ``n_added``, the number of spans that the trees added. A null
    text is empty and has no spans. Rows with equal id are searched one by one; an empty table gives no rows. The trees are trained on the driver
    with made-up spans in stretches of ``sample`` documents; equal tables give equal trees.
    """
    trees, limits = train(stretches(docs, id_col, text_col, sample))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, cell in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = cell.as_py() or ""
                base = base_spans(text)
                spans = all_spans(text, base, trees, limits)
                clean = None
                if redact:
                    clean, at = [], 0
                    for s, e, k in sorted((s, e, k) for k in KINDS for s, e in spans[k]):
                        if s >= at:
                            clean += [text[at:s], f"[{k}]"]
                            at = e
                    clean = "".join([*clean, text[at:]])
                rows.append((doc, *(len(base[k]) for k in BASE_KINDS), sum(map(len, spans.values())) - sum(map(len, base.values())), joined(base), joined(spans), clean))
            columns = list(zip(*rows, strict=True)) or [[]] * 9
            names = ["doc", *(f"n_{k}" for k in BASE_KINDS), "n_added", "base", "spans", "redacted"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 6 + [pa.string()] * 3, strict=True)], names=names)

    schema = "doc long, " + "".join(f"n_{k} long, " for k in BASE_KINDS) + "n_added long, base string, spans string, redacted string"
    found = docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(search, schema)
    return found.withColumnRenamed("doc", id_col) if redact else found.drop("redacted").withColumnRenamed("doc", id_col)
