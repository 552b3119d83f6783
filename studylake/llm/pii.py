"""Personal data by fixed patterns and a semi-Markov conditional random field.

The patterns give the base spans. The field then reads stretches of text around digits and at-signs, scores whole candidate spans (how many
digits in which groups, what the separators are, checksum, octets, the word before) for each kind, and a dynamic programme over
entities of bounded length chooses boundaries and kinds together. Its spans are added where they touch no base span:
addresses written with [at] and [dot], national phone numbers, cards in groups with other separators.
Outside such stretches no candidate exists and every label is 'none', so leaving them out doesn't change the best labelling. Only ASCII digits count as digits.
Very long texts are read whole, stretch by stretch; where two labellings score alike the one with fewer entities is taken.

The weights are fitted here, by the exact gradient of the conditional likelihood, on TRAINING sentences drawn from a fixed seed.

Nulls: a null text counts as empty and has no spans; a null id is kept. Repeated rows give equal results. An empty table gives an empty result. Columns besides
doc_id and text are not read (redact() passes every column on).
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from functools import lru_cache

from pyspark.sql import DataFrame

from .common import map_rows, text_of

KINDS = ("email", "ip", "card", "phone")
# The base patterns, written so that long runs are walked once.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Candidate spans have so many parts at most; TRAINING sentences are drawn; ROUNDS passes over them.
LONGEST, TRAINING, ROUNDS = 16, 400, 12
_NEAR = re.compile(r"[0-9@]|[\[(]\s?at\s?[\])]")
_BLANK = re.compile(r"\s")
_PART = re.compile(r"[A-Za-z]+|[0-9]+|[^\sA-Za-z0-9]")
_AT = re.compile(r"^[a-z0-9._%+-]+\s?(?:@|\[at\]|\(at\))\s?[a-z0-9-]+(?:(?:\.|\s?\[dot\]\s?|\s?\(dot\)\s?)[a-z0-9-]+)+$", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost, non-overlapping matches of each kind, failing ones dropped; by kind, then start."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        a = at
        while a > done and _LOCAL.match(text[a - 1]):
            a -= 1
        m = _DOMAIN.match(text, at + 1) if a < at else None
        if m:
            out.append(("email", a, m.end()))
        done = m.end() if m else at + 1
        at = text.find("@", done)
    if _NEAR.search(text):
        out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x[-9:]) <= 255 for x in m[0].split("."))]
        for m in _CARD.finditer(text):
            digits = re.sub("[^0-9]", "", m[0]) if m.end() - m.start() < 40 else ""
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
        if "+" in text:
            out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def stretches(text: str, reach: int = 80) -> list[tuple[int, int]]:
    """Where candidates can be: around digits and at-signs, widened to blanks at both ends. They don't overlap."""
    near: list[list[int]] = []
    for m in _NEAR.finditer(text):
        if near and m.start() - reach <= near[-1][1]:
            near[-1][1] = m.end() + reach
        else:
            near.append([max(0, m.start() - reach), m.end() + reach])
    out: list[list[int]] = []
    for a, b in near:
        least = out[-1][1] if out else 0
        if a > least:
            while a > least and not text[a - 1].isspace():
                a -= 1
        if m := _BLANK.search(text, max(b, least)):
            b = m.start()
        else:
            b = len(text)
        if out and a <= least:
            out[-1][1] = b
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def features(kind: str, span: str, before: str, digits: str, shape: str) -> list[str]:
    """What a whole span shows for a kind."""
    n, out = len(digits), []
    groups = [len(g) for g in re.findall("[0-9]+", span)]
    if kind == "email":
        out += ["address" if _AT.match(span) else "no address"]
    elif kind == "ip":
        out += ["octets" if len(groups) == 4 and re.fullmatch(r"[0-9]{1,3}(?:\s?(?:\.|\[\.\])\s?[0-9]{1,3}){3}", span) and max(map(int, re.findall("[0-9]+", span))) < 256 else "no octets"]
    elif kind == "card":
        out += ["card digits" if 15 <= n <= 19 else "no card digits", "luhn" if luhn(digits) else "no luhn", "even groups" if len(set(groups[:-1])) <= 1 and max(groups) >= 4 else "odd groups"]
    else:
        out += [f"phone digits {min(n, 16)}" if n >= 7 else "few digits", "phone shape" if re.fullmatch(r"(?:\+9{1,3}[ -]?)?(?:\(9{3}\) ?|9{3}[-. ])9{3}[-. ]9{4}|09{1,4}[-/ ]9{3,}(?:[- ]9+)*", shape) else "no phone shape", f"groups {min(len(groups), 6)}"]
    out.append("letters" if re.search("[A-Za-z]", span) else "no letters")
    if re.search(r"\+[0-9]*$", before):
        out.append("after a plus")
    if re.search(r"(?i)\b(phone|tel|call|mobile|fax)[.:]?$", before):
        out.append("says phone")
    if re.search(r"(?i)\b(card|visa|number)[.:]?$", before):
        out.append("says card")
    return [f"{kind} {x}" for x in out] + [f"{kind}"]


def candidates(text: str) -> tuple[list[tuple[int, int]], list[tuple[int, int, str, list[str]]]]:
    """The parts of a stretch, and (first part, past last part, kind, features) of its candidate spans."""
    parts = [(m.start(), m.end()) for m in _PART.finditer(text)]
    n, out, seen, ats = len(parts), [], [0], [0]
    for a, b in parts:
        seen.append(seen[-1] + (b - a if "0" <= text[a] <= "9" else 0))
        ats.append(ats[-1] + (text[a] == "@" or text[a:b].lower() == "at"))
    for i, (a, _) in enumerate(parts):
        if a and text[a - 1].isalnum() or not (text[a].isalnum() or text[a] in "(+"):
            continue
        for j in range(i + 1, min(n, i + LONGEST) + 1):
            b = parts[j - 1][1]
            # A new line ends a span, and so do two blanks.
            if j > i + 1 and (gap := text[parts[j - 2][1] : parts[j - 1][0]]) and (len(gap) > 1 or gap == "\n"):
                break
            d = seen[j] - seen[i]
            if (d < 4 and ats[j] == ats[i]) or b < len(text) and text[b].isalnum() or not text[b - 1].isalnum():
                continue
            if d > 22:
                break
            span = text[a:b]
            digits, shape, before = re.sub("[^0-9]", "", span), re.sub("[0-9]", "9", span), text[max(0, a - 12) : a].rstrip()
            if shape[:1] == "9" and digits[0] == "0":
                shape = "0" + shape[1:]
            if ats[j] > ats[i]:
                out.append((i, j, "email", features("email", span, before, digits, shape)))
            elif not re.search("[A-Za-z]", span):
                out += [(i, j, k, features(k, span, before, digits, shape)) for k in KINDS[1:]]
    return parts, out


def decode(n: int, scored: list[tuple[int, int, str, float]]) -> list[tuple[int, int, str]]:
    """The best labelling of n parts: parts of no entity score 0."""
    best, back, ending = [0.0] * (n + 1), [None] * (n + 1), {}
    for i, j, kind, s in scored:
        ending.setdefault(j, []).append((i, kind, s))
    for j in range(1, n + 1):
        best[j] = best[j - 1]
        for i, kind, s in ending.get(j, ()):
            if best[i] + s > best[j]:
                best[j], back[j] = best[i] + s, (i, kind)
    out, j = [], n
    while j:
        if back[j]:
            out.append((back[j][0], j, back[j][1]))
            j = back[j][0]
        else:
            j -= 1
    return out[::-1]


def expected(n: int, scored: list[tuple[int, int, str, float]]) -> list[float]:
    """Each candidate's probability, by the forward and backward sums."""
    plus = lambda a, b: max(a, b) + math.log1p(math.exp(-abs(a - b)))
    ahead, behind, ends, begins = [0.0] * (n + 1), [0.0] * (n + 1), {}, {}
    for c in scored:
        ends.setdefault(c[1], []).append(c)
        begins.setdefault(c[0], []).append(c)
    for j in range(1, n + 1):
        ahead[j] = ahead[j - 1]
        for i, _, _, s in ends.get(j, ()):
            ahead[j] = plus(ahead[j], ahead[i] + s)
    for i in range(n - 1, -1, -1):
        behind[i] = behind[i + 1]
        for _, j, _, s in begins.get(i, ()):
            behind[i] = plus(behind[i], behind[j] + s)
    return [math.exp(ahead[i] + s + behind[j] - ahead[n]) for i, j, _, s in scored]


def training_sentences(count: int = TRAINING, seed: int = 7) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Sentences of made-up words with labelled spans, and look-alikes that are not personal data: dates, versions, sums, ids, digits that fail the checksum."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice(["an", "er", "in", "the", "ou", "ste", "ka", "lo", "mi"]) for _ in range(r.randint(1, 3)))
    digits = lambda n: "".join(str(r.randint(0, 9)) for _ in range(n))

    def card(good: bool) -> str:
        while True:
            d = str(r.randint(2, 6)) + digits(15)
            if luhn(d) == good:
                return r.choice([" ", ".", "-", "/", ""]).join(d[i : i + 4] for i in range(0, 16, 4))

    yes = {
        "email": lambda: f"{word()}{r.choice(['', '.' + word(), digits(2)])}{r.choice([' [at] ', '(at)', ' (at) ', '[at]', '@'])}{word()}{r.choice([' [dot] ', '.', ' (dot) '])}{r.choice(['com', 'org', 'net', 'de'])}",
        "ip": lambda: r.choice([".", "[.]"]).join(str(r.randint(0, 255)) for _ in range(4)),
        "card": lambda: card(True),
        "phone": lambda: r.choice([lambda: f"({digits(3)}) {digits(3)}-{digits(4)}", lambda: f"{r.randint(2, 9)}{digits(2)}-{digits(3)}-{digits(4)}", lambda: f"0{digits(3)}/{digits(7)}", lambda: f"0{digits(2)} {digits(4)} {digits(4)}", lambda: f"+1 ({digits(3)}) {digits(3)}-{digits(4)}"])(),
    }
    no = [
        lambda: f"{r.randint(1990, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}", lambda: f"{r.randint(1, 9)}.{r.randint(0, 20)}.{r.randint(0, 20)}", lambda: digits(r.randint(1, 6)), lambda: card(False),
        lambda: f"{digits(2)}:{digits(2)}", lambda: f"{r.randint(1, 99)},{digits(3)},{digits(3)}", lambda: f"{word()} (at) {word()}", lambda: f"{word()} at {word()}", lambda: f"{r.randint(256, 999)}.{digits(3)}.{digits(3)}.{digits(3)}",
        lambda: digits(r.randint(7, 12)), lambda: " ".join(digits(2) for _ in range(r.randint(3, 9))), lambda: f"@{word()}", lambda: f"ISBN 978-{digits(1)}-{digits(4)}-{digits(4)}-{digits(1)}", lambda: f"{digits(4)} {digits(4)}", lambda: f"{r.randint(1900, 2030)}-{r.randint(1900, 2030)}",
    ]
    out = []
    for _ in range(count):
        text, spans = "", []
        for _ in range(r.randint(1, 3)):
            text += " ".join(word() for _ in range(r.randint(1, 4))) + " "
            kind = r.choice([*KINDS, None, None, None, None])
            piece = yes[kind]() if kind else r.choice(no)()
            if kind:
                if kind in ("phone", "card") and r.random() < 0.3:
                    text += {"phone": "call ", "card": "card "}[kind]
                spans.append((kind, len(text), len(text) + len(piece)))
            text += piece + r.choice([" ", ", ", ". "])
        out.append((text + word(), spans))
    return out


@lru_cache(maxsize=1)
def fitted() -> dict[str, float]:
    """Weights by AdaGrad on the conditional log-likelihood with a small ridge."""
    rows = []
    for text, spans in training_sentences():
        parts, found = candidates(text)
        gold = {(a, b, k) for k, a, b in spans}
        rows.append((len(parts), found, [(parts[i][0], parts[j - 1][1], k) in gold for i, j, k, _ in found]))
    weights: dict[str, float] = {}
    squares: dict[str, float] = {}
    for _ in range(ROUNDS):
        for n, found, gold in rows:
            p = expected(n, [(i, j, k, sum(weights.get(f, 0.0) for f in fs)) for i, j, k, fs in found])
            slope: dict[str, float] = {}
            for (_, _, _, fs), q, y in zip(found, p, gold, strict=True):
                if abs(y - q) > 1e-4:
                    for f in fs:
                        slope[f] = slope.get(f, 0.0) + y - q
            for f, g in slope.items():
                g -= 1e-3 * weights.get(f, 0.0)
                squares[f] = squares.get(f, 1e-3) + g * g
                weights[f] = weights.get(f, 0.0) + 0.5 * g / math.sqrt(squares[f])
    return weights


def field_spans(text: str, weights: dict[str, float]) -> list[tuple[str, int, int]]:
    """The field's own spans of a whole text."""
    out = []
    for a, b in stretches(text):
        parts, found = candidates(text[a:b])
        if found:
            scored = [(i, j, k, sum(weights.get(f, 0.0) for f in fs)) for i, j, k, fs in found]
            out += [(k, a + parts[i][0], a + parts[j - 1][1]) for i, j, k in decode(len(parts), [c for c in scored if c[3] > 0])]
    return out


def all_spans(text: str, weights: dict[str, float]) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, base and added spans), each by kind as listed, then start."""
    if not _NEAR.search(text):
        return [], []
    base = base_spans(text)
    taken = sorted((a, b) for _, a, b in base)
    free = lambda a, b: not any(x < b and a < y for x, y in taken)
    more = [(k, a, b) for k, a, b in field_spans(text, weights) if free(a, b)]
    return base, sorted(base + more, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def _written(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans, n_added."""
    weights = fitted()

    def start():
        def body(rows):
            out = []
            for doc, text in rows:
                base, spans = all_spans(text, weights)
                out.append((doc, *(sum(s[0] == k for s in base) for k in KINDS), hashlib.sha256(_written(base).encode()).hexdigest(), _written(spans), len(spans) - len(base)))
            return out

        return body

    plain = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text"))
    return map_rows(plain, start, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def redacted(text: str, weights: dict[str, float]) -> str:
    out, at = [], 0
    for kind, a, b in sorted(all_spans(text, weights)[1], key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """The documents with each span replaced by its kind in brackets; n_chars, where there is such a column, follows."""
    import pyarrow as pa

    weights, names = fitted(), docs.columns
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")

    def run(batches):
        for batch in batches:
            texts = [None if t is None else redacted(t, weights) for t in batch.column(names.index("text")).to_pylist()]
            columns = list(batch.columns)
            columns[names.index("text")] = pa.array(texts, pa.string())
            if "n_chars" in names:
                i = names.index("n_chars")
                columns[i] = pa.array([None if t is None else len(t) for t in texts], columns[i].type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(run, docs.schema)


