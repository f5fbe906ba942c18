"""Personal data: patterns, and a linear-chain conditional random field over word shapes for what patterns miss.

The field is trained once on the driver, from a small table of labelled sentences (sentence, position, token, tag), at
most MOST_TOKENS tokens of it; `labelled_table()` makes the default one from templates. Its weights (under 1 MB) travel with the tasks. Inside a task the
tokens near an anchor (a token with a digit or '@', or a spelt-out address) form windows; all windows of an Arrow
batch are decoded together by Viterbi, one numpy step a position. A token away from every anchor has only letters
and is outside by definition of the kinds, so whole texts are covered.

Base spans come from the patterns and always stay; decoded spans that overlap none of them are added.
Kinds: email, ip, card, phone, and from the field also secret (keys, passwords, tokens) and id (personal numbers).

Defined cases: a null text is empty and has no span; offsets are code points, ends exclusive; rows with equal ids are
independent; other columns are ignored. Very long tokens are shapes like any other. Empty tables give empty results.
"""

from __future__ import annotations

import random
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, session

KINDS = ("email", "ip", "card", "phone", "secret", "id")
#: email is [A-Za-z0-9._%+-]+ and then this; it is sought from each '@' backwards, so that a long run costs its length once.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
HOST = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: ip is [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+); chains of any length are cut to fours, so that a long run of digits costs its length once.
CHAIN = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int, str]]:
    """Leftmost non-overlapping addresses."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := HOST.match(text, at)):
            end = m.end()
            out.append((start, end, "email"))
        at = text.find("@", max(at + 1, end))
    return out


def addresses(text: str) -> list[tuple[int, int, str]]:
    """Leftmost non-overlapping fours of numbers with single dots between, all at most 255."""
    out = []
    for m in CHAIN.finditer(text):
        parts = m.group().split(".")
        at = m.start()
        for i in range(0, len(parts) - len(parts) % 4, 4):
            own = parts[i : i + 4]
            end = at + sum(map(len, own)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in own):
                out.append((at, end, "ip"))
            at = end + 1
    return out


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then by the order of kinds."""
    found = emails(text)
    if re.search("[0-9]", text):
        found += addresses(text)
        for m in CARD.finditer(text):
            digits = NOT_DIGIT.sub("", m.group())
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), m.end(), "card"))
        found += [(m.start(), m.end(), "phone") for m in PHONE.finditer(text) if 9 <= len(NOT_DIGIT.sub("", m.group())) <= 15]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


# --- the field -------------------------------------------------------------------------------------------------

TAGS = ("O", *KINDS)
FEATURES = 1 << 14
WORDS = frozenset("at dot call phone tel mobile fax card visa number password token key secret ip host ssn id passport mail email contact".split())


def shape(token: str) -> str:
    """Letters to a or A, digits to 9, runs to one sign; signs stay. Of the whole token, however long."""
    s = "".join("9" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c for c in token)
    return re.sub(r"(.)\1+", r"\1", s)


def traits(token: str) -> list[str]:
    """What one token says about itself."""
    s, core = shape(token), token.strip("\"'.,;:()[]<>")
    digits = sum(c.isdigit() for c in token)
    mixed = "mixed" if digits >= 2 and len(core) >= 12 and s.count("9") >= 2 else "plain"
    word = core.lower()
    return [f"s{s}", f"d{digits}", f"l{len(core) // 4}", mixed, "@" * ("@" in token) + "=" * ("=" in token) + "." * ("." in core), f"w{word if word in WORDS else ''}", f"{s[:1]}{s[-1:]}{digits > 0}"]


def feature_ids(tokens: list[str]) -> np.ndarray:
    """(len, k) hashed ids of each token's own traits and its neighbours' shapes."""
    own = [traits(t) for t in tokens]
    rows = []
    for i, mine in enumerate(own):
        before, after = own[i - 1] if i else ["<"] * 7, own[i + 1] if i + 1 < len(own) else [">"] * 7
        names = [*mine, "p" + before[0], "pw" + before[5], "n" + after[0], "nw" + after[5], "pd" + before[1] + mine[1], "nd" + after[1] + mine[1], "b"]
        rows.append([zlib.crc32(f"{j}{n}".encode()) % FEATURES for j, n in enumerate(names)])
    return np.array(rows, np.int64).reshape(len(tokens), -1)


def padded(windows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(n, longest, k) ids, and a mask of real positions."""
    lens = np.array([len(w) for w in windows])
    ids = np.zeros((len(windows), lens.max(), windows[0].shape[1]), np.int64)
    for i, w in enumerate(windows):
        ids[i, : len(w)] = w
    return ids, np.arange(lens.max())[None] < lens[:, None]


def viterbi(score: np.ndarray, mask: np.ndarray, move: np.ndarray) -> np.ndarray:
    """The best tags of every window at once; score: (n, t, tags), move: (tags, tags)."""
    best, back = score[:, 0], []
    for t in range(1, score.shape[1]):
        step = best[:, :, None] + move[None]
        arg = step.argmax(1)
        new = np.take_along_axis(step, arg[:, None], 1)[:, 0] + score[:, t]
        live = mask[:, t, None]
        back.append(np.where(live, arg, np.arange(best.shape[1])[None]))
        best = np.where(live, new, best)
    path = [best.argmax(1)]
    for arg in reversed(back):
        path.append(np.take_along_axis(arg, path[-1][:, None], 1)[:, 0])
    return np.stack(path[::-1], 1)


def trained(sentences: list[tuple[list[str], list[str]]], rounds: int = 80, rate: float = 0.3, l2: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Feature and transition weights by full-batch AdaGrad on the exact conditional likelihood."""
    ids, mask = padded([feature_ids(tokens) for tokens, _ in sentences])
    n, t, k = ids.shape
    tag = np.zeros((n, t), np.int64)
    for i, (_, tags) in enumerate(sentences):
        tag[i, : len(tags)] = [TAGS.index(x) for x in tags]
    m = len(TAGS)
    w, move = np.zeros((FEATURES, m)), np.zeros((m, m))
    gw, gm = np.full_like(w, 1e-6), np.full_like(move, 1e-6)
    gold = np.eye(m)[tag] * mask[..., None]
    both = mask[:, 1:] & mask[:, :-1]
    gold_moves = np.einsum("nta,ntb->ab", gold[:, :-1] * both[..., None], gold[:, 1:])

    def lse(x: np.ndarray, axis: int) -> np.ndarray:
        top = x.max(axis, keepdims=True)
        return np.log(np.exp(x - top).sum(axis)) + top.squeeze(axis)

    for _ in range(rounds):
        score = w[ids].sum(2)
        a, b = np.empty((n, t, m)), np.zeros((n, t, m))
        a[:, 0] = score[:, 0]
        for i in range(1, t):
            a[:, i] = np.where(mask[:, i, None], lse(a[:, i - 1, :, None] + move[None], 1) + score[:, i], a[:, i - 1])
        for i in range(t - 2, -1, -1):
            b[:, i] = np.where(mask[:, i + 1, None], lse(move[None] + (score[:, i + 1] + b[:, i + 1])[:, None], 2), b[:, i + 1])
        z = lse(a[:, -1], 1)
        p = np.exp(a + b - z[:, None, None]) * mask[..., None]
        pair = np.exp(a[:, :-1, :, None] + move + (score + b)[:, 1:, None] - z[:, None, None, None]) * both[..., None, None]
        dw = -l2 * w
        np.add.at(dw, ids.reshape(-1), np.repeat((gold - p).reshape(n * t, m), k, 0))
        dm = gold_moves - pair.sum((0, 1)) - l2 * move
        gw += dw**2
        gm += dm**2
        w += rate * dw / np.sqrt(gw)
        move += rate * dm / np.sqrt(gm)
    return w.astype(np.float32), move.astype(np.float32)


def labelled(n: int = 400, seed: int = 7) -> list[tuple[list[str], list[str]]]:
    """A small labelled table: n sentences of filler words around personal data, or numbers that are none, from templates."""
    r = random.Random(seed)
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    letters = lambda k, of="abcdefghijklmnopqrstuvwxyz": "".join(r.choice(of) for _ in range(k))
    name = lambda: letters(r.randint(3, 8))
    caps = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    makers = [
        ("email", lambda: f"{name()}.{digits(2)}@{name()}.com"), ("email", lambda: f"{name()}@{name()}.{name()}.org"),
        ("email", lambda: f"{name()} at {name()} dot com"), ("email", lambda: f"{name()} [at] {name()} [dot] net"),
        ("ip", lambda: ".".join(str(r.randint(1, 254)) for _ in range(4))),
        ("card", lambda: digits(16)), ("card", lambda: " ".join(digits(4) for _ in range(4))), ("card", lambda: "-".join(digits(4) for _ in range(4))),
        ("phone", lambda: f"+{r.randint(1, 99)} ({digits(3)}) {digits(3)}-{digits(4)}"), ("phone", lambda: f"({digits(3)}) {digits(3)}-{digits(4)}"),
        ("phone", lambda: f"{digits(3)}-{digits(3)}-{digits(4)}"), ("phone", lambda: f"+{digits(2)} {digits(3)} {digits(3)} {digits(4)}"),
        ("secret", lambda: f"AKIA{letters(16, caps)}"), ("secret", lambda: f"password={letters(r.randint(12, 20), '0123456789abcdef')}"),
        ("secret", lambda: f'"{letters(40, "0123456789abcdef")}"'), ("secret", lambda: f"key={letters(32, 'abcdefABCDEF0123456789')}"),
        ("id", lambda: f"{digits(3)}-{digits(2)}-{digits(4)}"),
        ("O", lambda: digits(r.randint(1, 4))), ("O", lambda: f"version {r.randint(1, 9)}.{r.randint(0, 9)}"), ("O", lambda: f"{r.choice('ABC')}{digits(2)}"),
        ("O", lambda: f"{digits(4)}-{digits(2)}-{digits(2)}"), ("O", lambda: f"{digits(1)},{digits(3)}"), ("O", lambda: f"{name()}{digits(1)}"),
        ("O", lambda: f"CC BY-NC {r.randint(1, 4)}.0"), ("O", lambda: f"{digits(2)}:{digits(2)}"), ("O", lambda: f"at {name()} dot"), ("O", lambda: f"{digits(3)}.{digits(2)}"),
    ]
    out = []
    for i in range(n):
        tag, make = makers[i % len(makers)]
        fill = lambda: [name() + r.choice(["", "", "", ".", ","]) for _ in range(r.randint(1, 4))]
        before, own, after = fill(), make().split(), fill()
        own[-1] += r.choice(["", "", ".", ","])
        out.append((before + own + after, ["O"] * len(before) + [tag] * len(own) + ["O"] * len(after)))
    return out


# --- windows -----------------------------------------------------------------------------------------------------

TOKEN = re.compile(r"\S+")
ANCHOR = re.compile(r"[0-9@]")
AT, DOT = re.compile(r" [(\[]?at[)\]]? (?=\S)"), re.compile(r" [(\[]?dot[)\]]? (?=\S)")
SPACES = re.compile(r"[ \t\n\r\x0b\x0c]")
#: Characters around an anchor that are decoded with it, and more up to whole tokens; tokens that are padded to one length together.
REACH, PADDED = 48, 40_000
#: Tokens of a stretch that are decoded at a time.
LONG = 20_000
TRIM_LEFT, TRIM_RIGHT = "\"'([<", "\"').,;:]>!?"


def token_end(text: str, at: int) -> int:
    m = SPACES.search(text, at)
    return m.start() if m else len(text)


def token_start(text: str, at: int, least: int) -> int:
    return 1 + max([least - 1, *(text.rfind(c, least, at) for c in SPACE)])


def spelt(text: str) -> Iterator[int]:
    """Where addresses like 'name at host dot org' begin, and where they end."""
    for m in AT.finditer(text):
        if dot := DOT.match(text, token_end(text, m.end())):
            yield token_start(text, m.start(), max(0, m.start() - REACH))
            yield token_end(text, dot.end()) - 1


def windows(text: str) -> Iterator[np.ndarray]:
    """Token spans (start, end) of the stretches around anchors; stretches are disjoint and hold whole tokens."""
    anchors = [m.start() for m in ANCHOR.finditer(text)]
    if " dot" in text or "dot)" in text or "dot]" in text:
        anchors = sorted([*anchors, *spelt(text)])
    i = end = 0
    while i < len(anchors):
        if anchors[i] < end:
            i += 1
            continue
        a = token_start(text, max(end, anchors[i] - REACH), end)
        end = token_end(text, min(len(text), anchors[i] + REACH))
        while i < len(anchors) and anchors[i] - REACH <= end:
            if anchors[i] + REACH > end:
                end = token_end(text, min(len(text), anchors[i] + REACH))
            i += 1
        yield np.fromiter((x for m in TOKEN.finditer(text, a, end) for x in m.span()), np.int64).reshape(-1, 2)


def batches_of(own: list[tuple[int, np.ndarray]]) -> Iterator[list[tuple[int, np.ndarray]]]:
    """Stretches, shortest first, so many at a time that padding them to one length stays within PADDED tokens."""
    part: list[tuple[int, np.ndarray]] = []
    for x in sorted(own, key=lambda x: len(x[1])):
        if part and (len(part) + 1) * len(x[1]) > PADDED:
            yield part
            part = []
        part.append(x)
    if part:
        yield part


def long_path(text: str, spans: np.ndarray, model: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The best tags of one long stretch, LONG tokens at a time: the scores of the tags so far go on from part to part, and a
    byte a token and tag tells the way back. Each part sees its neighbours' tokens, so this is the path of one run."""
    w, move = model
    n, best = len(spans), None
    back = np.zeros((n, len(move)), np.uint8)
    for i in range(0, n, LONG):
        j, low, high = min(n, i + LONG), max(0, i - 1), min(n, i + LONG + 1)
        score = w[feature_ids([text[a:b] for a, b in spans[low:high].tolist()])[i - low : j - low]].sum(1)
        for t in range(i, j):
            if best is None:
                best = score[0]
                continue
            step = best[:, None] + move
            back[t] = step.argmax(0)
            best = step.max(0) + score[t - i]
    path = np.zeros(n, np.int64)
    path[-1] = best.argmax()
    for t in range(n - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return path


def tagged(text: str, spans: np.ndarray, tags: np.ndarray) -> Iterator[tuple[int, int, str]]:
    """Runs of tokens of one kind, without the punctuation around them."""
    edge = np.flatnonzero(np.concatenate([[True], tags[1:] != tags[:-1], [True]]))
    for i, j in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        if tags[i]:
            a, b = int(spans[i, 0]), int(spans[j - 1, 1])
            token = text[a:b]
            if TAGS[tags[i]] == "secret" and "=" in token:
                a += token.index("=") + 1
            a += len(text[a:b]) - len(text[a:b].lstrip(TRIM_LEFT))
            b -= len(text[a:b]) - len(text[a:b].rstrip(TRIM_RIGHT))
            if a < b and re.search("[0-9@]| dot|[(\\[]dot", text[a:b]):
                yield a, b, TAGS[tags[i]]


def decoded(texts: list[str], model: tuple[np.ndarray, np.ndarray]) -> list[list[tuple[int, int, str]]]:
    """Spans by the field for each text: runs of tokens of one kind, without the punctuation around them."""
    w, move = model
    own = [(i, s) for i, t in enumerate(texts) for s in windows(t) if len(s)]
    out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    for i, s in own:
        if len(s) > LONG:
            out[i] += tagged(texts[i], s, long_path(texts[i], s, model))
    for part in batches_of([x for x in own if len(x[1]) <= LONG]):
        ids, mask = padded([feature_ids([texts[i][a:b] for a, b in s.tolist()]) for i, s in part])
        path = viterbi(w[ids].sum(2), mask, move)
        for (i, s), tags in zip(part, path, strict=True):
            out[i] += tagged(texts[i], s, tags[: len(s)])
    return out


def merged(base: list[tuple[int, int, str]], more: Iterable[tuple[int, int, str]]) -> list[tuple[int, int, str, bool]]:
    """Base spans, and those of more that overlap none of them; by start, then kind."""
    held: list[list[int]] = []  # what base spans cover, disjoint and in order
    for a, b, _ in sorted(base):
        if held and a < held[-1][1]:
            held[-1][1] = max(held[-1][1], b)
        else:
            held.append([a, b])
    starts = [a for a, _ in held]

    def free(a: int, b: int) -> bool:
        k = bisect_left(starts, b)  # the last one that begins before b
        return not k or held[k - 1][1] <= a

    out = [(*s, True) for s in base] + [(*s, False) for s in more if free(s[0], s[1])]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


SPANS = "array<struct<kind:string,start:long,end:long,base:boolean>>"


#: Tokens of the labelled table that the field is fitted on at most, unless find() is told another number.
MOST_TOKENS = 100_000


def labelled_table(spark: SparkSession) -> DataFrame:
    """The default labelled table: sentence, position, token, tag."""
    rows = [(i, k, t, g) for i, (tokens, tags) in enumerate(labelled()) for k, (t, g) in enumerate(zip(tokens, tags, strict=True))]
    return spark.createDataFrame(rows, "sentence long, position long, token string, tag string")


def sentences_of(table: DataFrame, most_tokens: int = MOST_TOKENS) -> list[tuple[list[str], list[str]]]:
    """The whole sentences within the first most_tokens tokens of a labelled table (of a longer first one, so many tokens);
    unknown tags are outside, null tokens go."""
    out: dict[int, tuple[list[str], list[str]]] = {}
    rows = table.filter("token IS NOT NULL").orderBy("sentence", "position", "token").limit(most_tokens + 1).collect()
    if len(rows) > most_tokens:
        rows = [r for r in rows if r["sentence"] != rows[-1]["sentence"]] or rows[:-1]
    for r in rows:
        tokens, tags = out.setdefault(r["sentence"], ([], []))
        tokens.append(r["token"])
        tags.append(r["tag"] if r["tag"] in TAGS else "O")
    return list(out.values())


def find(docs: DataFrame, table: DataFrame | None = None, most_tokens: int = MOST_TOKENS) -> DataFrame:
    """docs: doc_id, text. Returns doc_id and spans: (kind, start, end, base) by start, then kind. table: labelled
    sentences (sentence, position, token, tag) to train the field on, at most most_tokens of them; an empty one finds base
    spans only."""
    spark = session(docs.sparkSession)
    sentences = sentences_of(labelled_table(spark) if table is None else table, most_tokens)
    model = trained(sentences) if sentences else None
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            spans = [[{"kind": k, "start": a, "end": e, "base": own} for a, e, k, own in merged(base_spans(t), more)] for t, more in zip(texts, decoded(texts, model) if model else [[]] * len(texts), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, kind)], ["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, f"doc_id long, spans {SPANS}")
