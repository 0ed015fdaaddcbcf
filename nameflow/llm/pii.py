r"""Personal data by a semi-Markov conditional random field beside fixed patterns.

Base spans come from the patterns below and always stay.  The model adds spans the patterns miss, such as numbers
with other separators or addresses with words in place of their marks.

The model scores labelled segmentations: features of a whole candidate span (its shape with runs squeezed, digits,
groups, separators, checks such as Luhn's, the characters beside it) weigh for its type, outside tokens weigh for none.
Entities hold at most MAX_TOKENS tokens and MOST_DIGITS digits; they hold either one mark of an address - an @, or the word
`at` and after it the word `dot` or a full stop - or no letter, at most MOST_GROUPS groups of digits and LEAST_DIGITS digits or
four groups of three at most.  So a text falls into zones - runs of words around digits and marks, and one word more on either
side - and outside them nothing is an entity; within a zone a dynamic program over ends and
lengths chooses boundaries and types jointly.  Training maximises the likelihood of segmentations of zones made from seeded
templates (forward sums over the same lattice), on the driver and alike for every corpus.

Defined results: null counts as empty and has no spans; added spans never touch base spans; repeated rows
stay repeated; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import functools
import hashlib
import math
import random
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import session

KINDS = ("email", "ip", "card", "phone")
#: Fixed patterns of the base spans.
EMAIL_LEFT, EMAIL_RIGHT = re.compile(r"[A-Za-z0-9._%+-]+\Z"), re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: A match can only begin where a run of digits does, and takes runs whole, so long runs are read once.
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
MAX_TOKENS, LEAST_DIGITS, MOST_DIGITS, MOST_GROUPS = 24, 10, 24, 6
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Matches of EMAIL from their marks: the local part is the run of its characters before one."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        a = at
        while a > last and text[a - 1] in _LOCAL:
            a -= 1
        if a < at and (m := EMAIL_RIGHT.match(text, at)):
            out.append((a, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start, then kind as listed."""
    out = [("email", a, b) for a, b in _emails(text)]
    if any(map(text.__contains__, "0123456789")):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append(("ip", m.start(), m.end()))
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 14:
                d = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(d) <= 19 and luhn(d):
                    out.append(("card", m.start(), m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 10 <= sum(map(str.isdigit, m[0])) <= 15:
                    out.append(("phone", m.start(), m.end()))
    out.sort(key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
    return out


_TOKEN = re.compile(r"[A-Za-z0-9]+|[^\sA-Za-z0-9]")
#: Seeds of zones: words with a digit or a mark of an address, and words for such marks.
_SEED = re.compile(r"(?<!\S)(?:\S*(?:[0-9@]|[(\[{](?i:at|dot)[)\]}])\S*|(?i:at|dot)(?!\S))")
#: The word beside a zone; no part of an address is longer than 254.
_NEXT, _PREVIOUS = re.compile(r"\s{1,8}\S{1,254}(?!\S)"), re.compile(r"(?<!\S)\S{1,254}\s{1,8}\Z")
_AT = re.compile(r"\s*[(\[{]\s?at\s?[)\]}]\s*|\sat\s|@")
_DOT = re.compile(r"\s*[(\[{]\s?(?i:dot)\s?[)\]}]\s*|\s(?i:dot)\s|\s\.\s")
_ENDS = frozenset("com org net edu gov mil int info biz io co de fr es it nl eu uk us ca au ch at be pt pl se example".split())
_COMMON = frozenset("the a an this that these those his her its our your my their on of in to and or is was were be for with from by it he she they we you i".split())
_SHAPE = str.maketrans({**{c: "9" for c in "0123456789"}, **{c: "a" for c in "abcdefghijklmnopqrstuvwxyz"}, **{c: "A" for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}})
_RUNS = re.compile(r"([aA9])\1+")
_GROUPS, _PLAIN, _DOT_WORD = re.compile("[0-9]+"), re.compile("[A-Za-z0-9]"), re.compile(r"[ (\[{]dot[ )\]}]")
_MARK_FIRST, _MARK_LAST = re.compile(r"[(\[{]?\s?(?:at|dot)\b"), re.compile(r"\b(?:at|dot)\Z")


def zones(text: str) -> Iterator[tuple[int, int]]:
    """Runs of seed words with at most one plain word between, with one word on either side."""
    done, first, last = 0, -1, -1

    def widened(end: int) -> tuple[int, int]:
        before, after = _PREVIOUS.search(text[max(done, first - 263) : first]), _NEXT.match(text, last, end)
        return first - len(before[0]) if before else first, after.end() if after else last

    for m in _SEED.finditer(text):
        a = m.start()
        if first >= 0:
            if a - last <= 271 and len(text[last:a].split()) <= 1:
                last = m.end()
                continue
            zone = widened(a)
            done = zone[1]
            yield zone
        first, last = a, m.end()
    if first >= 0:
        yield widened(len(text))


def span_features(text: str, a: int, b: int) -> list[str]:
    s = text[a:b]
    digits = sum(c in "0123456789" for c in s)
    shape = _RUNS.sub(r"\1+", s.translate(_SHAPE))
    groups = _GROUPS.findall(s)
    low = s.lower()
    before = text[max(0, a - 1) : a]
    after = text[b : b + 1]
    dotted = "dot" in low or " . " in s
    flat = _DOT.sub(".", low) if dotted else low
    at = _AT.search(flat) if "at" in flat or "@" in flat else None
    sep = "".join(sorted(set(_PLAIN.sub("", s))))[:4]
    if at:
        lead, name = flat[: at.start()], flat[at.end() :]
        ends = name.rpartition(".")[2]
        bare = not digits and at[0].strip() == "at"
        common = any(w in _COMMON for w in (*lead.split(), *re.split(r"[\s.]+", name)))
        # brackets in pairs, and no mark at either end
        whole = all(s.count(x) == s.count(y) for x, y in ("()", "[]", "{}")) and not _MARK_FIRST.match(low) and not _MARK_LAST.search(low)
        # words for a dot right before or after: the span is part of a longer address
        part = any(m.end() == len(x) for x in (text[max(0, a - 9) : a],) for m in _DOT.finditer(x)) or bool(_DOT.match(text, b))
        address = f"True{min(len(lead.split()), 3)}{min(len(name.split()), 3)}{'.' in name}{lead[:1].isalnum()}"
        more = [
            f"address={address}", f"ends=True{ends in _ENDS}", f"bare={bare}{ends in _ENDS}{common}", f"stop=True{'. ' in flat}{bare}", f"part={part}", f"whole={whole}True{part}",
            f"form={address}{whole and not part}{ends in _ENDS}{common}",
        ]
    else:
        more = ["no address"]
    digit_run = "".join(groups)
    return [
        f"shape={shape[:24]}", f"digits={min(digits, 20)}", f"groups={min(len(groups), 8)}", f"sep={sep}", f"lens={','.join(str(len(g)) for g in groups[:6])}",
        f"edge={before in ('', ' ') or before in '([<:;,'}{after == '' or not (after.isalnum())}", f"luhn={13 < digits < 20 and luhn(digit_run)}",
        f"octets={len(groups) == 4 and all(len(g) < 4 and int(g) < 256 for g in groups)}", f"alpha={digits * 2 < len(s)}",
        f"at={'@' in s}{'at' in low and ' ' in s}", f"dot={'.' in s}{dotted and bool(_DOT_WORD.search(low))}", f"plus={s[0] == '+'}",
        f"zero={s[0] == '0'}{min(digits, 20)}", f"local={len(digit_run) == 10 and digit_run[0] in '23456789' and digit_run[3] in '23456789'}",
        f"start={s[0].isalnum() or s[0] in '+('}", f"end={s[-1].isalnum()}", *more,
    ]


class SemiCrf:
    """Weights by (kind or None, feature).  None stands for single tokens outside entities."""

    def __init__(self) -> None:
        self.w: dict[tuple[str | None, str], float] = {}
        #: the weights of a feature for all kinds together, once fitted
        self.by: dict[str, tuple[float, ...]] = {}

    def lattice(self, text: str, lo: int, hi: int) -> tuple[list[tuple[int, int]], dict[tuple[int, int], list[str]]]:
        tokens = [m.span() for m in _TOKEN.finditer(text, lo, hi)]
        spans = {}
        parts = [text[a:b] for a, b in tokens]
        kinds = ["digits" if p.isdigit() else "letters" if p.isalnum() else p for p in parts]
        for i, (a, _) in enumerate(tokens):
            if not (text[a].isalnum() or text[a] in "+("):
                continue
            digits = groups = 0
            at = dot = letters = False
            octets = True
            for j in range(i, min(i + MAX_TOKENS, len(tokens))):
                part, kind = parts[j], kinds[j]
                if kind == "digits":
                    digits, groups, octets = digits + len(part), groups + 1, octets and len(part) < 4
                elif kind == "letters":
                    digits += sum(c in "0123456789" for c in part)
                    letters = True
                    mark = part.lower()
                    if mark == "at":
                        if at:
                            break
                        at = True
                    elif mark == "dot":
                        dot = dot or at
                elif kind == "@":
                    if dot or "@" in parts[i:j]:
                        break
                    at = dot = True
                elif kind == ".":
                    dot = dot or at
                if digits > MOST_DIGITS:
                    break
                if not part[-1].isalnum():
                    continue
                if at and dot:
                    address = j - i >= 2 or digits >= LEAST_DIGITS
                elif letters:
                    continue
                else:
                    if groups > MOST_GROUPS:
                        continue
                    address = digits >= LEAST_DIGITS or (groups == 4 and octets)
                if address:
                    spans[i, j + 1] = span_features(text, a, tokens[j][1])
        return tokens, spans

    def scores(self, spans: dict) -> dict[tuple[int, int], list[float]]:
        if self.by:
            none, by = (0.0,) * len(KINDS), self.by
            return {k: [sum(x) for x in zip(*(by.get(f, none) for f in feats), strict=True)] for k, feats in spans.items()}
        w = self.w
        return {k: [sum(w.get((kind, f), 0.0) for f in feats) for kind in KINDS] for k, feats in spans.items()}

    def outside(self, text: str, token: tuple[int, int]) -> float:
        return self.w.get((None, self.token_shape(text, token)), 0.0)

    @staticmethod
    def token_shape(text: str, token: tuple[int, int]) -> str:
        s = text[token[0] : token[1]]
        return f"out={_RUNS.sub(r'\1+', s.translate(_SHAPE))[:12]}{min(len(s), 5)}"

    def best(self, text: str, lo: int, hi: int) -> list[tuple[str, int, int]]:
        """The likeliest segmentation's entities."""
        tokens, spans = self.lattice(text, lo, hi)
        if not spans:
            return []
        score, into = self.scores(spans), {}
        for i, j in spans:
            into.setdefault(j, []).append(i)
        value, back = [0.0] * (len(tokens) + 1), [None] * (len(tokens) + 1)
        for j in range(1, len(tokens) + 1):
            value[j] = value[j - 1] + self.outside(text, tokens[j - 1])
            for i in into.get(j, ()):
                for k, s in enumerate(score[i, j]):
                    if value[i] + s > value[j]:
                        value[j], back[j] = value[i] + s, (i, k)
        out, j = [], len(tokens)
        while j:
            if back[j]:
                i, k = back[j]
                out.append((KINDS[k], tokens[i][0], tokens[j - 1][1]))
                j = i
            else:
                j -= 1
        return out[::-1]

    def fit(self, examples: list[tuple[str, list[tuple[str, int, int]]]], epochs: int = 6, rate: float = 0.4) -> SemiCrf:
        """Ascends the likelihood of the examples' segmentations by forward and backward sums."""
        w, square = self.w, {}
        for epoch in range(epochs):
            for text, gold in examples:
                tokens, spans = self.lattice(text, 0, len(text))
                n, score = len(tokens), self.scores(spans)
                out = [self.outside(text, t) for t in tokens]
                into: dict[int, list] = {}
                for i, j in spans:
                    into.setdefault(j, []).append(i)
                add = lambda x, y: max(x, y) + math.log1p(math.exp(-abs(x - y)))
                alpha = [0.0] * (n + 1)
                for j in range(1, n + 1):
                    alpha[j] = alpha[j - 1] + out[j - 1]
                    for i in into.get(j, ()):
                        for s in score[i, j]:
                            alpha[j] = add(alpha[j], alpha[i] + s)
                beta, outof = [0.0] * (n + 1), {}
                for i, j in spans:
                    outof.setdefault(i, []).append(j)
                for i in range(n - 1, -1, -1):
                    beta[i] = beta[i + 1] + out[i]
                    for j in outof.get(i, ()):
                        for s in score[i, j]:
                            beta[i] = add(beta[i], s + beta[j])
                grad: dict = {}
                z = alpha[n]
                first = {t[0]: i for i, t in enumerate(tokens)}
                last = {t[1]: i + 1 for i, t in enumerate(tokens)}
                true = {(first.get(a), last.get(b)): KINDS.index(k) for k, a, b in gold}
                inside = {t for (i, j) in true if i is not None and j is not None for t in range(i, j)}
                for (i, j), s in score.items():
                    for k in range(len(KINDS)):
                        d = (true.get((i, j)) == k) - math.exp(min(0.0, alpha[i] + s[k] + beta[j] - z))
                        if abs(d) > 1e-3:
                            for f in spans[i, j]:
                                grad[KINDS[k], f] = grad.get((KINDS[k], f), 0.0) + d
                for t in range(n):
                    d = (t not in inside) - math.exp(min(0.0, alpha[t] + out[t] + beta[t + 1] - z))
                    if abs(d) > 1e-3:
                        f = (None, self.token_shape(text, tokens[t]))
                        grad[f] = grad.get(f, 0.0) + d
                for f, d in grad.items():
                    square[f] = square.get(f, 0.0) + d * d
                    w[f] = w.get(f, 0.0) + rate * d / math.sqrt(square[f])
        self.by = {f: tuple(w.get((k, f), 0.0) for k in KINDS) for _, f in w}
        return self


def examples(n: int = 1000, seed: int = 23) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Zones with known entities, from templates and numbers of no meaning, and zones without any."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghiklmnoprstuvwz") for _ in range(r.randint(2, 9)))
    num = lambda k: "".join(r.choice("0123456789") for _ in range(k))

    def card() -> str:
        d = r.choice("3456") + num(r.choice((13, 14, 14, 14, 14)))
        d += next(c for c in "0123456789" if luhn(d + c))
        sep = r.choice((" ", "-", ".", "/"))
        return sep.join(d[i : i + 4] for i in range(0, len(d), 4))

    def phone() -> str:
        return r.choice((f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"{num(3)}.{num(3)}.{num(4)}", f"+{num(1)} ({num(3)}) {num(3)}-{num(4)}", f"00{num(2)} {num(3)} {num(3)} {num(4)}", f"1-{num(3)}-{num(3)}-{num(4)}", f"{num(3)} {num(7)}", f"0{num(4)} {num(6)}", f"{r.choice('23456789')}{num(2)}{r.choice('23456789')}{num(6)}"))

    def ip() -> str:
        o = [str(r.randint(0, 255)) for _ in range(4)]
        return r.choice((".", ".", "[.]", " . ")).join(o)

    def email() -> str:
        at, dot = r.choice((("@", "."), (" at ", " dot "), (" [at] ", " [dot] "), ("(at)", "(dot)"), ("@", " . "), (" AT ", " DOT "), (" (at) ", " (dot) "), (" at ", ".")))
        end = r.choice(("com", "org", "net", "edu", "io", "de"))
        if r.random() < 0.6:
            return f"{word()}{r.choice(('', '.' + word(), '_' + word(), dot + word(), dot + word()))}{at}{word()}{r.choice(('', '', dot + word()))}{dot}{end}" if (at, dot) != ("@", ".") else f"{word()}{at}{word()} . {end}"
        return f"{word()}.{num(2)}{at}{word()}{num(1)}{dot}{word()}" if r.random() < 0.6 else f"{word()}{num(1)}{at}{word()}{dot}{end}"

    def prose() -> str:
        few = lambda: r.choice(("the", "a", "his", "on", "of", "in", "to", "and", "is", "was", word(), word()))
        return r.choice((f"{few()} at {few()}", f"{word()} at {word()}. {word()}", f"{few()} at {word()} {word()}", f"{few()} at the {word()} dot {few()}", f"{word()} at {r.choice(('the', 'a', 'his'))} dot {few()}", f"{word()} dot {word()}", f"{word()} at {num(1)}:{num(2)}", f"at {few()} {word()} at {few()} {word()}. {word()}", f"{word()} at {word()}, {num(2)}", f"{word()} at {num(4)}. {word()}"))

    def nothing() -> str:
        y, m, d = str(r.randint(1900, 2035)), f"{r.randint(1, 12):02}", f"{r.randint(1, 28):02}"
        return r.choice((num(r.randint(1, 9)), f"{y}-{m}-{d}", f"{d}.{m}.{y}", f"{num(1)}.{num(1)}.{num(2)}", f"{num(2)}:{num(2)}:{num(2)}", f"{num(1)},{num(3)},{num(3)}", f"{num(3)}.{num(2)}", f"v{num(1)}.{num(2)}", f"{word()}{num(3)}", f"{num(2)}.{num(3)}.{num(2)}.", f"1{num(9)}", f"{num(2)}.{num(1)}.{num(1)}.{r.randint(256, 999)}", f"{r.randint(256, 999)}.{num(2)}.{num(1)}.{num(2)}", f"{word()}_{num(2)}_{word()}", f"{num(4)} {num(4)}", f"{num(4)}-{num(4)}", f"{word()}@{word()}", f"{num(16)}", f"{num(3)}-{num(2)}", "".join(r.choice("abcdef0123456789") for _ in range(r.choice((8, 16, 32))))))

    makers = {"email": email, "ip": ip, "card": card, "phone": phone}
    out = []
    for _ in range(n):
        text, gold = word() + " " if r.random() < 0.5 else "", []
        for _ in range(r.randint(1, 2)):
            kind = r.choice((*KINDS, "email", None, None, None, None, None))
            s = makers[kind]() if kind else nothing() if r.random() < 0.6 else prose()
            if kind:
                gold.append((kind, len(text), len(text) + len(s)))
            text += s + r.choice((" ", ", ", ". ", "; ")) + (word() + " " if r.random() < 0.7 else "")
        out.append((text.rstrip(), gold))
    return out


@functools.cache
def trained() -> SemiCrf:
    return SemiCrf().fit(examples())


def find(text: str, model: SemiCrf) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, all spans)"""
    base = base_spans(text)
    added = []
    for lo, hi in zones(text):
        here = [s for s in base if s[1] < hi and s[2] > lo]
        # base spans cut the zone; what they leave is searched
        at, pieces = lo, []
        for _, a, b in sorted(here, key=lambda s: s[1]):
            if a > at:
                pieces.append((at, a))
            at = max(at, b)
        if at < hi:
            pieces.append((at, hi))
        for a, b in pieces:
            if b - a >= 7:
                added += model.best(text, a, b)
    if not added:
        return base, base
    return base, sorted(base + added, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with every span replaced by its kind in angle brackets; overlapping spans become one."""
    out, at, end = [], 0, 0
    for k, a, b in spans:
        if a >= end:
            out += [text[at:a], f"<{k}>"]
        at = end = max(end, b)
    return "".join([*out, text[at:]])


_FOUND = "n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_added bigint, n_spans bigint"


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, counts of base spans by kind, base_sha256, spans (all), n_added, n_spans."""
    model = session(docs).sparkContext.broadcast(trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[] for _ in range(8)]
            for text in b.column(1).to_pylist():
                base, every = find(text or "", model.value)
                for i, k in enumerate(KINDS):
                    cols[i].append(sum(s[0] == k for s in base))
                cols[4].append(hashlib.sha256(joined(base).encode()).hexdigest())
                cols[5].append(joined(every))
                cols[6].append(len(every) - len(base))
                cols[7].append(len(every))
            kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names=["doc_id", *(x.split()[0] for x in _FOUND.split(", "))])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col)).mapInArrow(run, f"doc_id {kind}, {_FOUND}")


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with every span of their texts masked; null texts stay null."""
    model = session(docs).sparkContext.broadcast(trained())
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [None if t is None else masked(t, find(t, model.value)[1]) for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(texts, b.column(i).type) if i == at else b.column(i) for i in range(b.num_columns)], schema=b.schema)

    return docs.mapInArrow(run, docs.schema)
