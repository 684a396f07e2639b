"""Personal data: fixed patterns, and a linear-chain conditional random field that adds what they miss.

The field labels tokens from the shapes of a token and its neighbours, is trained here from the small labelled table
below by gradient ascent on the exact likelihood, and is decoded by Viterbi over numpy batches of equally long runs. Only
tokens near a digit, an at-sign or a bracketed "at" or "dot" can carry a label; all others are outside by constraint,
so a text falls into short independent runs and decoding them is exact for the whole text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import mapped, sliced, text_bytes

KINDS = ("email", "ip", "card", "phone")
TAGS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
#: Tokens on each side of a telling one that may carry a label too.
REACH = 2
EPOCHS, RATE, PENALTY = 150, 0.1, 0.01

# Labelled table: {kind|text} marks a span.
LABELLED = """
write to {email|anna.lee (at) example (dot) org} about it
please mail {email|tom [at] mail [dot] example [dot] com} today
contact {email|j.smith [at] example.com} or come by
send it to {email|kim(at)example.net} before noon
reach me at {email|info[at]example[dot]org} thanks
mail {email|sara_b@example} for this
you can write {email|max (at) example.com}
my address is {email|r.roe[at]mail.example.com} since May
call me on {phone|(415) 555-0134} after six
phone {phone|415-555-0187} or leave a note
her number is {phone|(212) 555 0199} at home
the office is {phone|555-867-5309} in town
call {phone|020 7946 0958} for the desk
dial {phone|415.555.0142} and wait
tel {phone|030-1234567} in the morning
ring {phone|(030) 555 0171} now
a fax to {phone|001 415 555 0166} went out
the host {ip|192.168.0.1:8080} is down
log in from {ip|10.0.0.12/24} only
server {ip|172 . 16 . 0 . 9} answered
address {ip|10 . 1 . 2 . 3} was blocked
node {ip|192[.]168[.]4[.]20} was seen
from {ip|203[.]0[.]113[.]9} came a request
card {card|4111.1111.1111.1111} was used
paid with {card|5500.0000.0000.0004} on Monday
number {card|4012/8888/8888/1881} expires soon
card {card|4222_2222_2222_2220} was charged
the year 2019 was good
in 1999 and 2004 they met
about 250 people and 12 dogs came
version 3.2.1 is out now
see chapter 4.2 on page 117
it cost 1,250.00 in all
the score was 3-2 at the end
open from 9:00 to 17:30 every day
on 2021-03-04 it rained
on 12/05/2020 we left
take 2 or 3 of them
a code of 7f3a9c2e41d0 was set
token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" was left there
id 883920175533 in the list
order 1234567890123456 was sent
ratio 0.125 and 0.5 remain
he scored 88% in test 3
the 4th of 7 rows
pages 10-20 and 31-40
Apache License, Version 2.0. applies
General Public License, version 3. applies
see @home and @work for more
the set [12] and (3) of notes
room 101 on floor 2
"""

_CARD = re.compile(rb"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(rb"\+[0-9][\x20().0-9-]+[0-9]")
_DOTTED = re.compile(rb"(?<![0-9])[0-9]++(?:\.[0-9]++)+")
_DOMAIN = re.compile(rb"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_TELLING = re.compile(rb"[0-9@]|[\[(](?:at|dot|\.)[\])]", re.I)
_TOKEN = re.compile(rb"[^\x20\x09-\x0D]+")
_DIGIT = re.compile(rb"[0-9]")
_LOCAL_BYTES = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: Characters that an added span of the kinds ip, card and phone may hold.
_WRITTEN = {1: rb"[0-9.\[\]:/ ]+", 2: rb"[0-9._/ -]+", 3: rb"[0-9+(). /-]+"}
_SPACES = frozenset(b" \t\n\x0b\x0c\r")


def luhn(digits: bytes) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = c - 48
        if i % 2:
            n = 2 * n - 9 * (n > 4)
        total += n
    return total % 10 == 0


def base_spans(text: bytes) -> list[tuple[int, int, int]]:
    """(start, place of the kind in KINDS, end) in bytes, in order: the patterns of the four kinds and their checks.

    Linear in the text: an address starts at the reach of the at-sign to the left, numbers at their first digit.
    """
    found = []
    done = at = 0
    while (at := text.find(b"@", at)) >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_BYTES:
            start -= 1
        match = _DOMAIN.match(text, at + 1) if start < at else None
        if match:
            found.append((start, 0, match.end()))
            done = match.end()
        at = max(at + 1, done)
    if not _DIGIT.search(text):
        return found
    for match in _DOTTED.finditer(text):
        parts = match[0].split(b".")
        start = match.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = start + sum(map(len, four)) + 3
            if all(len(p.lstrip(b"0")) <= 3 and int(p.lstrip(b"0") or b"0") <= 255 for p in four):
                found.append((start, 1, end))
            start = end + 1
    for match in _CARD.finditer(text):
        if match.end() - match.start() >= 12:
            digits = match[0].translate(None, b" -")
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((match.start(), 2, match.end()))
    if b"+" in text:
        for match in _PHONE.finditer(text):
            if 9 <= len(match[0].translate(None, b" ().+-")) <= 15:
                found.append((match.start(), 3, match.end()))
    return sorted(found)


def runs(text: bytes) -> list[list[tuple[int, int]]]:
    """Runs of tokens (start, end) that may carry a label: those near telling characters, within one line."""
    out: list[list[tuple[int, int]]] = []
    seen = -1
    for match in _TELLING.finditer(text):
        if match.start() < seen:
            continue
        start, end = match.start(), match.end()
        while start and text[start - 1] not in _SPACES:
            start -= 1
        end = _TOKEN.match(text, match.start()).end()
        seen = end
        left: list[tuple[int, int]] = []
        p = start
        for _ in range(REACH):
            q = p
            while q and text[q - 1] in b" \t":
                q -= 1
            if not q or text[q - 1] in _SPACES or q == p:
                break
            p = q
            while p and text[p - 1] not in _SPACES:
                p -= 1
            left.append((p, q))
        tokens = [*reversed(left), (start, end)]
        p = end
        for _ in range(REACH):
            q = p
            while q < len(text) and text[q] in b" \t":
                q += 1
            token = _TOKEN.match(text, q) if q > p else None
            if not token:
                break
            tokens.append(token.span())
            p = token.end()
        if out and tokens[0][0] <= out[-1][-1][0]:
            last = out[-1][-1][0]
            out[-1] += [t for t in tokens if t[0] > last]
        elif out and b"\n" not in (gap := text[out[-1][-1][1] : tokens[0][0]]) and not gap.strip():
            out[-1] += tokens
        else:
            out.append(tokens)
    return out


def shape(token: bytes) -> str:
    """A for capitals, a for letters, 0 for digits, other characters as they are; repeats are written once."""
    out = []
    for c in token:
        s = "0" if 48 <= c <= 57 else "A" if 65 <= c <= 90 else "a" if 97 <= c <= 122 or c > 127 else chr(c)
        if not out or out[-1] != s:
            out.append(s)
    return "".join(out)


def _own(token: bytes) -> list[str]:
    digits = sum(48 <= c <= 57 for c in token)
    low = token.lower()
    out = [f"shape={shape(token)}", f"digits={min(digits, 20)}", f"first={shape(token[:1])}", f"last={shape(token[-1:])}", f"size={min(len(token), 20) // 4}"]
    for name, inside in (("at", b"@" in token), ("atword", b"at)" in low or b"at]" in low), ("dotword", b"dot)" in low or b"dot]" in low), ("dots", b"." in token), ("plain", not digits and token.isalpha())):
        if inside:
            out.append(name)
    return out


def features(tokens: list[bytes]) -> list[list[str]]:
    own = [_own(t) for t in tokens]
    return [
        ["bias", *own[i], *(f"-1 {f}" for f in (own[i - 1] if i else ["edge"])), *(f"+1 {f}" for f in (own[i + 1] if i + 1 < len(own) else ["edge"]))]
        for i in range(len(own))
    ]


def examples() -> list[tuple[list[bytes], list[int]]]:
    """Tokens and tags of the labelled table."""
    out = []
    for line in LABELLED.strip().split("\n"):
        tokens, tags = [], []
        for part in re.findall(r"\{[a-z]+\|[^}]*\}|[^ {]+", line):
            marked = re.fullmatch(r"\{([a-z]+)\|(.*)\}", part)
            for k, word in enumerate((marked[2] if marked else part).split(" ")):
                tokens.append(word.encode())
                tags.append(TAGS.index(f"{'I' if k else 'B'}-{marked[1]}") if marked else 0)
        out.append((tokens, tags))
    return out


def _sum_exp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


class Field:
    """Weights by feature and tag, and by neighbouring tags."""

    def __init__(self, names: dict[str, int], weights: np.ndarray, steps: np.ndarray):
        self.names, self.weights, self.steps = names, weights, steps

    def emissions(self, tokens: list[bytes]) -> np.ndarray:
        rows = [[self.names[f] for f in fs if f in self.names] for fs in features(tokens)]
        return np.array([self.weights[r].sum(axis=0) for r in rows])

    def decode(self, batch: np.ndarray) -> np.ndarray:
        """Best tags of equally long runs (runs x tokens x tags) by Viterbi; tags that can't start or follow are barred."""
        n, length, k = batch.shape
        barred = np.array([[0.0 if t == "O" or t[0] == "B" or s[1:] == t[1:] and s != "O" else -1e9 for t in TAGS] for s in TAGS])
        best = batch[:, 0] + barred[0]
        back = np.zeros((n, length, k), dtype=np.int8)
        for i in range(1, length):
            options = best[:, :, None] + self.steps + barred
            back[:, i] = options.argmax(axis=1)
            best = options.max(axis=1) + batch[:, i]
        out = np.zeros((n, length), dtype=np.int8)
        out[:, -1] = best.argmax(axis=1)
        for i in range(length - 1, 0, -1):
            out[:, i - 1] = np.take_along_axis(back[:, i], out[:, i : i + 1].astype(np.int64), axis=1)[:, 0]
        return out


def train() -> Field:
    """Fit to the labelled table: forward-backward over its lines, ridge penalty, momentum-scaled ascent (Adam)."""
    data = examples()
    rows = [features(tokens) for tokens, _ in data]
    names = {f: i for i, f in enumerate(sorted({f for r in rows for fs in r for f in fs}))}
    k = len(TAGS)
    length = max(len(t) for t, _ in data)
    active = np.zeros((len(data), length, len(names)))
    gold = np.zeros((len(data), length), dtype=int)
    mask = np.zeros((len(data), length), dtype=bool)
    for a, (r, (_, tags)) in enumerate(zip(rows, data)):
        for b, fs in enumerate(r):
            active[a, b, [names[f] for f in fs]] = 1
            gold[a, b], mask[a, b] = tags[b], True
    parts = [np.zeros((len(names), k)), np.zeros((k, k))]
    first, second = [[np.zeros_like(p) for p in parts] for _ in range(2)]
    one = np.eye(k)[gold] * mask[..., None]
    both = mask[:, 1:]
    true_steps = np.einsum("abi,abj->ij", one[:, :-1] * both[..., None], one[:, 1:])
    for epoch in range(1, EPOCHS + 1):
        w, s = parts
        emit = active @ w
        ahead = [emit[:, 0]]
        for i in range(1, length):
            new = _sum_exp(ahead[-1][:, :, None] + s, 1) + emit[:, i]
            ahead.append(np.where(mask[:, i, None], new, ahead[-1]))
        behind = [np.zeros((len(data), k))]
        for i in range(length - 1, 0, -1):
            new = _sum_exp(s[None] + (emit[:, i] + behind[0])[:, None, :], 2)
            behind.insert(0, np.where(mask[:, i, None], new, behind[0]))
        z = _sum_exp(ahead[-1], 1)
        ahead_, behind_ = np.stack(ahead, 1), np.stack(behind, 1)
        share = np.exp(ahead_ + behind_ - z[:, None, None]) * mask[..., None]
        pair = np.exp(ahead_[:, :-1, :, None] + s + (emit[:, 1:] + behind_[:, 1:])[:, :, None, :] - z[:, None, None, None]) * both[..., None, None]
        slopes = [np.einsum("abf,abk->fk", active, one - share) - PENALTY * w, true_steps - pair.sum(axis=(0, 1)) - PENALTY * s]
        for x, g, m, v in zip(parts, slopes, first, second):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            x += RATE * (m / (1 - 0.9**epoch)) / (np.sqrt(v / (1 - 0.999**epoch)) + 1e-8)
    return Field(names, *parts)


def _plausible(kind: int, span: bytes) -> bool:
    """Checks on what the field proposes, looser than the patterns' in form but not in content."""
    low = span.lower()
    numbers = re.findall(rb"[0-9]+", span)
    digits = b"".join(numbers)
    if kind == 0:
        return bool(re.search(rb"[a-z0-9]\s*(?:@|[\[(]at[\])])\s*[a-z0-9]", low))
    if not re.fullmatch(_WRITTEN[kind], span):
        return False
    if kind == 1:
        return len(numbers) >= 4 and all(len(x) <= 3 and int(x) <= 255 for x in numbers[:4])
    if kind == 2:
        return 12 <= len(digits) <= 19 and luhn(digits)
    return 9 <= len(digits) <= 15 and len(numbers) >= 2


def added_spans(texts: list[bytes], base: list[list[tuple[int, int, int]]], field: Field) -> list[list[tuple[int, int, int]]]:
    """What the field finds clear of the patterns' spans, by text: runs of all texts are decoded together by length."""
    by_length: dict[int, list[tuple[int, list[tuple[int, int]]]]] = {}
    for i, text in enumerate(texts):
        for run in runs(text) if _TELLING.search(text) else ():
            by_length.setdefault(len(run), []).append((i, run))
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for length in sorted(by_length):
        some = by_length[length]
        width = max(1, 20_000 // length)
        for s in range(0, len(some), width):
            part = some[s : s + width]
            tags = field.decode(np.stack([field.emissions([texts[i][a:b] for a, b in run]) for i, run in part]))
            for (i, run), row in zip(part, tags):
                k = 0
                while k < length:
                    if not row[k]:
                        k += 1
                        continue
                    kind, j = (int(row[k]) - 1) // 2, k + 1
                    while j < length and row[j] == 2 * kind + 2:
                        j += 1
                    start, end = run[k][0], run[j - 1][1]
                    while end > start and _ends_sentence(texts[i][end - 1]):
                        end -= 1
                    if _plausible(kind, texts[i][start:end]) and not any(a < end and start < b for a, _, b in base[i]):
                        out[i].append((start, kind, end))
                    k = j
    return out


def _ends_sentence(byte: int) -> bool:
    """Punctuation that ends a sentence rather than a span."""
    return byte in b".,;:!?#$%&*"


def to_points(text: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Byte offsets to code points."""
    places = sorted({p for a, _, b in spans for p in (a, b)})
    at, done, points = {}, 0, 0
    for p in places:
        points += len(text[done:p].decode())
        at[p], done = points, p
    return [(at[a], kind, at[b]) for a, kind, b in spans]


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_email``, ``n_ip``, ``n_card``, ``n_phone`` (the patterns' spans), ``base_sha256``, ``spans``
    (all, the field's too), ``n_added`` of every row.

    Null and empty texts have no spans. Rows that repeat are searched each; other columns are ignored.
    """
    field = docs.sparkSession.sparkContext.broadcast(train())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts = text_bytes(batch.column(1))
            base = [base_spans(t) for t in texts]
            more = added_spans(texts, base, field.value)
            counts = [[sum(s[1] == k for s in b) for b in base] for k in range(4)]
            points = [to_points(t, b) for t, b in zip(texts, base)]
            every = [p + to_points(t, m) if m else p for t, p, m in zip(texts, points, more)]
            columns = [
                *(pa.array(c, pa.int64()) for c in counts),
                pa.array([hashlib.sha256(written(p).encode()).hexdigest() for p in points], pa.string()),
                pa.array([written(e) for e in every], pa.string()),
                pa.array([len(m) for m in more], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return mapped(rows, run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def mask(text: bytes, spans: list[tuple[int, int, int]]) -> bytes:
    """The text with each span, overlapping ones together, written as its kind in brackets."""
    out, done = [], 0
    for start, kind, end in sorted(spans):
        if start >= done:
            out += [text[done:start], b"[" + KINDS[kind].upper().encode() + b"]"]
        done = max(done, end)
    return b"".join([*out, text[done:]])


def masked(docs: DataFrame) -> DataFrame:
    """The documents, all columns, with personal data in ``text`` masked and ``n_chars``, where there is one, brought up to date; a null text stays null."""
    field = docs.sparkSession.sparkContext.broadcast(train())
    at, size = docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else -1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 512):
            texts = text_bytes(batch.column(at))
            base = [base_spans(t) for t in texts]
            more = added_spans(texts, base, field.value)
            known = batch.column(at).is_valid().to_pylist()
            new = pa.array([mask(t, b + m).decode() if ok else None for t, b, m, ok in zip(texts, base, more, known)], pa.string())
            batch = batch.set_column(at, batch.schema.field(at).with_type(pa.string()), new)
            if size >= 0:
                batch = batch.set_column(size, batch.schema.field(size), pc.utf8_length(new).cast(batch.schema.field(size).type))
            yield batch

    return mapped(docs, run, docs.schema)
