"""Secret scans: three base rules, and a linear-chain conditional random field for secrets that they miss.

Tokens (runs of letters, digits and -_+/, other signs one by one) are tagged as a secret's begin, inside or outside. A token's score adds up
weights of its own shape, of its neighbouring words and of features of its file; begin, inside and outside follow each other by
learned transitions. The field is fitted on a bounded sample of windows whose tags the base rules give, some with other
key names and values put in. Viterbi decoding is exact: a token whose score for outside leads by more than all transitions and its
successor could make up for is outside on every best path, so only the stretches between such tokens are decoded, many at once.
"""

from __future__ import annotations

import random
import re
import string
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import blocks
from .bpe import distinct
from .pretokens import DIGIT, LETTER, SPACE, char_classes

KINDS = ("assign", "access", "hex", "crf")
KEYS = ("password", "passwd", "secret", "token", "api_key", "apikey")
ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
ASSIGN_CHARS, ACCESS_CHARS, HEX_CHARS, CRF_CHARS = 8, 16, 32, 12  # least lengths
LABELLED = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{8}|AKIA[A-Z0-9]{12}|[0-9a-f]{32}"""

SAMPLE = 600  # texts with base spans, and texts without, that the fit uses: those of the least hashes of id and text
WINDOWS, REACH, LONG_SPAN = 2, 120, 200  # of a text: windows, code points on each side of a span, longest span
# Names and forms of secrets beyond the base rules that are put into windows of the sample.
MORE_KEYS = ("auth", "authorization", "bearer", "credential", "private_key", "client_key", "access_key", "session_id", "signature", "pwd", "pass", "passphrase", "key", "webhook", "dsn", "jwt")
ALPHABETS = (string.ascii_letters + string.digits, string.ascii_lowercase + string.digits, string.ascii_uppercase + string.digits, string.ascii_letters + string.digits + "_-", string.ascii_letters + string.digits + "+/")
FORMS = ('{k} = "{v}"', "{k}={v}", "{k}: {v}", "{k}: '{v}'", "{k} {v}", '"{k}": "{v}"', "{k}_{v}")

BEGIN, INSIDE, OUTSIDE = TAGS = range(3)
BITS = 15  # features are hashed to this many bits
OWN, AROUND = 10, (-3, -2, -1, 1)  # features of a token itself; places of the neighbours that count
COPIES = 2  # times that the fit uses a window
MADE, HARMLESS = 0.75, 0.25  # share of windows that something is put into, and share of these where it is no secret
NAME_COUNT, NAME_CHARS = 4, 20  # a word's identity counts if the sample has it so often
STEPS, RATE, DECAY = 120, 0.15, 1e-5
FORBIDDEN = -1e6
LEAD = 0.5  # by which a span's tags must lead: added to the score of outside

_WORD_SIGNS = "-_+/"


def hex_runs(codes: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of hex digits long enough, none over the begin of a text."""
    hexed = np.zeros(len(codes) + 2, dtype=bool)
    hexed[1:-1] = ((codes >= 48) & (codes <= 57)) | ((codes >= 97) & (codes <= 102))
    edge = hexed[1:] != hexed[:-1]
    inner = begins[(begins > 0) & (begins < len(codes))]
    both = inner[hexed[inner] & hexed[inner + 1]]
    edge = np.flatnonzero(edge)
    starts, ends = (np.sort(np.concatenate([x, both])) if len(both) else x for x in (edge[0::2], edge[1::2]))
    long = ends - starts >= HEX_CHARS
    return starts[long], ends[long]


def base_spans(texts: list[str], codes: np.ndarray, begins: np.ndarray) -> list[list[tuple[int, int, int, int, int]]]:
    """Per text its base spans in order: start, place of the kind in KINDS, end, and the begin and end of the secret itself."""
    found: list[list[tuple[int, int, int, int, int]]] = [[] for _ in texts]
    for i, text in enumerate(texts):
        low = text.lower()
        if any(k in low for k in KEYS):
            found[i] += [(m.start(), 0, m.end(), m.start(1), m.end(1)) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= ASSIGN_CHARS]
        if "AKIA" in text:
            found[i] += [(m.start(), 1, m.end(), m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_CHARS]
    starts, ends = hex_runs(codes, begins)
    of = np.searchsorted(begins, starts, side="right") - 1
    for i, a, b in zip(of.tolist(), (starts - begins[of]).tolist(), (ends - begins[of]).tolist(), strict=True):
        found[i].append((a, 2, b, a, b))
    return [sorted(x) for x in found]


@dataclass
class Tokens:
    """Tokens of some texts: their code point ranges in all texts, each text's first token (one more at the end), and distinct ones."""

    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    words: list[str]
    word: np.ndarray

    @classmethod
    def of(cls, texts: list[str], codes: np.ndarray, begins: np.ndarray) -> Tokens:
        kind = char_classes()[codes]
        word = (kind == LETTER) | (kind == DIGIT)
        for sign in _WORD_SIGNS:
            word |= codes == ord(sign)
        sign = ~word & (kind != SPACE)
        before = np.concatenate([[False], word[:-1]])
        before[begins[begins < len(codes)]] = False
        starts = np.flatnonzero((word & ~before) | sign)
        after = np.concatenate([word[1:], [False]])
        after[begins[(begins > 0) & (begins < len(codes))] - 1] = False
        ends = np.flatnonzero((word & ~after) | sign) + 1
        wide = 1 + (codes >= 0x80).astype(np.int8) + (codes >= 0x800) + (codes >= 0x10000)
        at = np.concatenate([[0], np.cumsum(wide, dtype=np.int64)])
        data = np.frombuffer("".join(texts).encode(), dtype=np.uint8)
        first = np.searchsorted(starts, np.concatenate([begins, [len(codes)]]))
        if not len(starts):
            return cls(starts, ends, first, [], starts)
        one, inverse, _ = distinct(data, at[starts], at[ends])
        raw = data.tobytes()
        return cls(starts, ends, first, [raw[a:b].decode() for a, b in zip(at[starts[one]].tolist(), at[ends[one]].tolist(), strict=True)], inverse)


def laid_out(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, and where each text begins."""
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    return np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32), np.cumsum(sizes) - sizes


def _feature(*parts: object) -> int:
    return crc32("\x1f".join(map(str, parts)).encode()) & ((1 << BITS) - 1)


def _step(x: float, *limits: float) -> int:
    return sum(x >= limit for limit in limits)


SIZES = (2, 4, 8, 12, 16, 20, 28, 40, 64)
SIGN, PLAIN, NUMBER, SHORT_MIX, LONG_MIX, ODD_CASE, OTHER = range(7)


@lru_cache(maxsize=1 << 10)
def _plain(size: int, name: str) -> tuple:
    """Of a word of letters in a usual case: its size and, if it is a known name, its name are all that counts."""
    own = (_feature("class", PLAIN), _feature("size", size, PLAIN), *(_feature("plain", k) for k in range(OWN - 3)), _feature("word", name))
    return own, (_feature("name", name), _feature("kind", PLAIN, size)), PLAIN, False, False


def word_features(word: str, names: frozenset[str]) -> tuple[tuple[int, ...], tuple[int, int], int, bool, bool]:
    """Own features, the two that a neighbour sees, coarse class, whether it has a digit, whether it is a single sign."""
    n = len(word)
    size = _step(n, *SIZES)
    low = word.lower()
    name = low if low in names else ""
    if word.isalpha() and (word.islower() or word.isupper() or word[1:].islower()):
        return _plain(size, name)
    marks = "".join("a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else "-" if c in _WORD_SIGNS else "?" for c in word[:400])
    letters, digits = sum(c in "aA" for c in marks), marks.count("0")
    runs = 1 + sum(x != y for x, y in zip(marks, marks[1:]))
    if n == 1 and not (letters or digits):
        coarse = SIGN
    elif digits and (letters or "?" in marks):
        coarse = LONG_MIX if n >= 8 else SHORT_MIX
    elif digits:
        coarse = NUMBER
    elif runs >= 4 and n >= 8 and "a" in marks and "A" in marks:
        coarse = ODD_CASE
    else:
        coarse = PLAIN if letters else OTHER
    shape = re.sub(r"(.)\1+", r"\1", marks)[:8]
    own = (
        _feature("class", coarse), _feature("size", size, coarse), _feature("kinds", "".join(sorted(set(marks))), size), _feature("runs", _step(runs, 2, 3, 4, 6, 8, 12, 16, 24), size),
        _feature("shape", shape), _feature("hex", all(c in "0123456789abcdef" for c in low), size), _feature("variety", _step(len(set(word[:400])) / min(n, 400), 0.2, 0.35, 0.5, 0.7, 0.9), size),
        _feature("vowels", _step(sum(c in "aeiou" for c in low[:400]) / max(1, letters), 0.08, 0.16, 0.24, 0.36, 0.5), size, coarse), _feature("digits", _step(digits / min(n, 400), 0.01, 0.1, 0.25, 0.4, 0.7, 1), size),
        _feature("word", name),
    )
    return own, (_feature("name", name), _feature("kind", coarse, size)), coarse, digits > 0, coarse == SIGN


class WordFeatures(dict):
    """word_features of the words met; names are the words whose identity counts."""

    def __init__(self, names: frozenset[str]):
        self.names = names

    def __missing__(self, word: str):
        found = word_features(word, self.names)
        if len(self) < 1 << 17 and len(word) <= 64:
            self[word] = found
        return found


def file_features(tokens: Tokens, number: np.ndarray, sign: np.ndarray) -> np.ndarray:
    """Three features of each text: steps of its token count and of its shares of tokens with digits and of single signs."""
    n = np.diff(tokens.first)
    share = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags[tokens.word])])[tokens.first]) / np.maximum(n, 1)
    return np.stack([np.digitize(n, [8, 32, 128, 512, 2048]), np.digitize(share(number), [0.01, 0.03, 0.1, 0.25]), np.digitize(share(sign), [0.05, 0.1, 0.2, 0.35])], axis=1)


@dataclass
class Field:
    """Weights of hashed features for each tag, one table for the token itself, one for each neighbour's place and one for the file; transitions."""

    weights: np.ndarray  # (1 + len(AROUND) + 1, 2**BITS, 3)
    moves: np.ndarray  # from tag, to tag
    names: frozenset[str]  # words whose identity counts

    def emissions(self, tokens: Tokens, known: WordFeatures) -> np.ndarray:
        """Score of each tag at each token."""
        found = [known[w] for w in tokens.words]
        if not found:
            return np.zeros((0, 3))
        own, seen = np.array([f[0] for f in found]), np.array([f[1] for f in found])
        coarse, number, sign = np.array([f[2] for f in found]), np.array([f[3] for f in found]), np.array([f[4] for f in found])
        out = self.weights[0][own].sum(axis=1)[tokens.word]
        for k, step in enumerate(AROUND):
            gain = self.weights[1 + k][seen].sum(axis=1)
            at = neighbours(tokens.first, step)
            there = at >= 0
            out[there] += gain[tokens.word[at[there]]]
        of = np.repeat(np.arange(len(tokens.first) - 1), np.diff(tokens.first))
        file = file_features(tokens, number, sign)
        for j in range(file.shape[1]):
            table = np.array([[_feature(j, step, c) for c in range(7)] for step in range(7)])
            out += self.weights[-1][table[file[of, j], coarse[tokens.word]]]
        return out

    def decode(self, scores: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The best tags; texts begin and end as if outside."""
        tags = np.full(len(scores), OUTSIDE, dtype=np.int8)
        if not len(scores):
            return tags
        allowed = self.moves[self.moves > FORBIDDEN / 2]
        swing = 3 * (allowed.max() - allowed.min())
        after = np.concatenate([np.maximum(0, scores[1:, INSIDE] - scores[1:, BEGIN]), [0]])
        open_ = scores[:, OUTSIDE] - np.maximum(scores[:, BEGIN], scores[:, INSIDE]) <= swing + after
        begin = np.zeros(len(scores) + 1, dtype=bool)
        begin[first] = True
        before = np.concatenate([[False], open_[:-1]])
        starts = np.flatnonzero(open_ & (~before | begin[:-1]))
        behind = np.concatenate([open_[1:], [False]])
        ends = np.flatnonzero(open_ & (~behind | begin[1:])) + 1
        order = np.argsort(starts - ends, kind="stable")  # longest first, so that those still open come first
        starts, sizes = starts[order], (ends - starts)[order]
        best, back = None, []
        for t in range(int(sizes[0]) if len(sizes) else 0):
            live = int(np.searchsorted(-sizes, -t, side="left"))
            now = scores[starts[:live] + t]
            if t == 0:
                best, finals = self.moves[OUTSIDE] + now, np.zeros((len(sizes), 3))
                back.append(None)
            else:
                ways = best[:live, :, None] + self.moves
                back.append(ways.argmax(axis=1).astype(np.int8))
                best = ways.max(axis=1) + now
            finals[:live] = best
        last = (finals + self.moves[:, OUTSIDE]).argmax(axis=1) if len(sizes) else None
        for t in range(len(back) - 1, -1, -1):
            live = int(np.searchsorted(-sizes, -t, side="left"))
            tags[starts[:live] + t] = last[:live]
            if t:
                last[:live] = back[t][np.arange(live), last[:live]]
        return tags


def neighbours(first: np.ndarray, step: int) -> np.ndarray:
    """For each token the one step places on in its text, -1 if there is none."""
    n = int(first[-1])
    at = np.arange(n) + step
    of = np.repeat(np.arange(len(first) - 1), np.diff(first))
    return np.where((at >= first[of]) & (at < first[of + 1]), at, -1)


def spans_of(tags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last token of each tagged span."""
    starts = np.flatnonzero(tags == BEGIN)
    inside = np.concatenate([tags[1:] == INSIDE, [False]])
    stops = np.flatnonzero((tags != OUTSIDE) & ~inside)
    return starts, stops


def windows(text: str, spans: list[tuple[int, int, int, int, int]], draw: int) -> list[tuple[str, list[int]]]:
    """Windows of a text for the fit, each with the begins and ends of secrets in it; one at a drawn place if it has none."""
    secrets = sorted({(a, b) for _, _, _, a, b in spans})
    out = []
    for a, b in [s for s in secrets if s[1] - s[0] <= LONG_SPAN][:WINDOWS] if secrets else [(draw % max(1, len(text)),) * 2]:
        low, high = max(0, a - REACH), min(len(text), b + REACH)
        while low > 0 and not text[low - 1].isspace() and a - low < 2 * REACH:
            low -= 1
        inside = [(x, y) for x, y in secrets if x < high and y > low]
        if all(low <= x and y <= high for x, y in inside):
            out.append((text[low:high], [p - low for s in inside for p in s]))
    return out


def harmless(rng: random.Random, text: str) -> str:
    """Something of letters, digits and signs that is no secret: a path, an address, a version or a name of joined words."""
    words = re.findall(r"[^\W\d_]+", text) or ["a"]
    some = [rng.choice(words) for _ in range(rng.randrange(2, 5))]
    number = str(rng.randrange(10 ** rng.randrange(1, 7)))
    return rng.choice((
        "/" + "/".join(some) + f"_{number}.{some[0][:3]}", f"https://{some[0]}.com/" + "-".join(some) + f"/{number}?id={rng.randrange(10**6)}", f"v{rng.randrange(9)}.{rng.randrange(20)}-{some[0]}+{number}",
        "".join(w.capitalize() for w in some) + number, "_".join(some) + number, "-".join(some), f"{number}-{rng.randrange(10**4)}-{rng.randrange(10**4)}",
    ))


def put_in(rng: random.Random, text: str, spans: list[int]) -> tuple[str, list[int]]:
    """The window with a made secret, or something harmless, at a space outside the spans."""
    value = "".join(rng.choices(rng.choice(ALPHABETS), k=rng.randrange(16, 49)))
    if rng.random() < 0.15:
        value = "-".join(value[i : i + 5] for i in range(0, len(value), 5))
    lead, new = rng.choice(FORMS).format(k=rng.choice(MORE_KEYS + KEYS).replace("_", rng.choice("_-")), v="\0"), []
    places = [i for i, c in enumerate(text) if c == " " and not any(a <= i < b for a, b in zip(spans[::2], spans[1::2]))]
    at = rng.choice(places) + 1 if places else len(text)
    if rng.random() < HARMLESS:
        piece = harmless(rng, text) + " "
    else:
        piece, begin = lead.replace("\0", value) + " ", at + lead.index("\0")
        new = [begin, begin + len(value)]
    moved = [p + len(piece) if p >= at else p for p in spans]
    return text[:at] + piece + text[at:], moved + new


def tagged(tokens: Tokens, begins: np.ndarray, spans: list[list[int]]) -> np.ndarray:
    tags = np.full(len(tokens.starts), OUTSIDE, dtype=np.int8)
    for begin, pairs in zip(begins.tolist(), spans, strict=True):
        for a, b in sorted(zip(pairs[::2], pairs[1::2])):
            x, y = np.searchsorted(tokens.ends, begin + a, side="right"), np.searchsorted(tokens.starts, begin + b)
            tags[x:y] = INSIDE
            if x < y and not (x and tags[x - 1] != OUTSIDE and tokens.ends[x - 1] > begin + a):
                tags[x] = BEGIN
    return tags


def fit(sample: list[tuple[str, list[int]]], seed: int = 1) -> Field:
    """Fit the field on windows by full-batch Adam steps on the penalised conditional likelihood."""
    rng = random.Random(seed)
    rows = [put_in(rng, *row) if rng.random() < MADE else row for _ in range(COPIES) for row in sample]
    texts, spans = [t for t, _ in rows], [s for _, s in rows]
    moves = np.zeros((3, 3))
    moves[OUTSIDE, INSIDE] = FORBIDDEN
    field = Field(np.zeros((2 + len(AROUND), 1 << BITS, 3)), moves, frozenset())
    codes, begins = laid_out(texts)
    tokens = Tokens.of(texts, codes, begins)
    n = len(tokens.starts)
    if not n:
        return field
    tags = tagged(tokens, begins, spans)
    often = Counter(dict(zip(tokens.words, np.bincount(tokens.word).tolist(), strict=True)))
    field.names = frozenset(w.lower() for w, k in often.items() if k >= NAME_COUNT and len(w) <= NAME_CHARS)
    found = [word_features(w, field.names) for w in tokens.words]
    own, seen = np.array([f[0] for f in found])[tokens.word], np.array([f[1] for f in found])
    coarse, number, sign = (np.array([f[k] for f in found]) for k in (2, 3, 4))
    of = np.repeat(np.arange(len(texts)), np.diff(tokens.first))
    file = file_features(tokens, number, sign)[of]
    # one list of (token, feature) over all tables
    at = [np.repeat(np.arange(n), OWN)]
    cells = [own.reshape(-1)]
    for k, step in enumerate(AROUND):
        place = neighbours(tokens.first, step)
        there = np.flatnonzero(place >= 0)
        at.append(np.repeat(there, 2))
        cells.append((seen[tokens.word[place[there]]] + ((1 + k) << BITS)).reshape(-1))
    for j in range(file.shape[1]):
        table = np.array([[_feature(j, step, c) for c in range(7)] for step in range(7)])
        at.append(np.arange(n))
        cells.append(table[file[:, j], coarse[tokens.word]] + ((1 + len(AROUND)) << BITS))
    at, cells = np.concatenate(at), np.concatenate(cells)
    used, cells = np.unique(cells, return_inverse=True)
    width = int(np.diff(tokens.first).max())
    slot = np.arange(n) - tokens.first[of]
    counts = np.diff(tokens.first)
    truth = np.eye(3)[tags]
    bounds = np.zeros((3, 3))
    before = np.where(slot > 0, np.concatenate([[OUTSIDE], tags[:-1]]), OUTSIDE)
    np.add.at(bounds, (before, tags), 1)
    np.add.at(bounds, (tags[tokens.first[1:][counts > 0] - 1], OUTSIDE), 1)
    weights, steps = np.zeros((len(used), 3)), np.zeros((3, 3))
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (weights, steps)]
    for round_ in range(1, STEPS + 1):
        scores = np.stack([np.bincount(at, weights[cells, k], minlength=n) for k in TAGS], axis=1)
        marginal, pairs = expectations(scores, moves + steps, of, slot, counts, width)
        rest = truth - marginal
        grads = (np.stack([np.bincount(cells, rest[at, k], minlength=len(used)) for k in TAGS], axis=1) / n - DECAY * weights, (bounds - pairs) / n - DECAY * steps)
        for value, grad, (mean, square) in zip((weights, steps), grads, state, strict=True):
            mean += 0.1 * (grad - mean)
            square += 0.01 * (grad * grad - square)
            value += RATE * (mean / (1 - 0.9**round_)) / (np.sqrt(square / (1 - 0.99**round_)) + 1e-8)
    field.weights.reshape(-1, 3)[used] = weights
    field.moves = moves + steps
    return field


def expectations(scores: np.ndarray, moves: np.ndarray, of: np.ndarray, slot: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of each token's tag and expected moves, by forward and backward passes over all windows at once."""
    padded = np.zeros((len(counts), width, 3))
    padded[of, slot] = np.exp(scores - scores.max(axis=1, keepdims=True))
    step = np.exp(moves)
    forward, backward = np.zeros_like(padded), np.zeros_like(padded)
    now = np.repeat(np.eye(3)[[OUTSIDE]], len(counts), axis=0)
    for t in range(width):
        now = (now @ step) * padded[:, t]
        now = now / np.maximum(now.sum(axis=1, keepdims=True), 1e-300)
        forward[:, t] = now
    now = np.zeros((len(counts), 3))
    for t in range(width - 1, -1, -1):
        ends = (counts == t + 1)[:, None]
        now = np.where(ends, step[:, OUTSIDE], now)
        backward[:, t] = now
        now = (padded[:, t] * now) @ step.T
        now = now / np.maximum(now.sum(axis=1, keepdims=True), 1e-300)
    both = (forward * backward)[of, slot]
    marginal = both / both.sum(axis=1, keepdims=True)
    total = np.zeros((3, 3))
    some = counts > 0
    previous = np.repeat(np.eye(3)[[OUTSIDE]], len(counts), axis=0)
    for t in range(width):
        live = counts > t
        joint = previous[live][:, :, None] * step * (padded[live, t] * backward[live, t])[:, None, :]
        total += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        previous = forward[:, t]
    last = forward[np.flatnonzero(some), counts[some] - 1] * step[:, OUTSIDE]
    total[:, OUTSIDE] += (last / last.sum(axis=1, keepdims=True)).sum(axis=0)
    return marginal, total


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Field:
    """Fit the field on windows of at most sample texts with base spans and as many without, those of the least hashes of id and text.

    Counts of both by steps of a sixteenth in the hash's binary logarithm tell where to stop, so the driver receives two short tables of
    counts and at most 2 * sample rows of WINDOWS windows.
    """
    hashed = F.xxhash64(id_col, text_col)
    rank = F.floor(F.log2((F.shiftrightunsigned(hashed, 11) + 1) / float(1 << 53)) * 16).cast("int")
    rows = docs.where(F.octet_length(text_col) > 0).select(F.col(text_col).alias("text"), hashed.alias("draw"), rank.alias("rank"), F.col(text_col).rlike(LABELLED).alias("labelled"))
    limits = {}
    for labelled, step, n in sorted(rows.groupBy("labelled", "rank").count().collect()):
        total, limit = limits.get(labelled, (0, None))
        if total < sample:
            limits[labelled] = (total + n, step)
    if not limits:
        return fit([])
    chosen = F.lit(False)
    for labelled, (_, limit) in limits.items():
        chosen |= (F.col("rank") <= limit) & (F.col("labelled") == labelled)

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            texts = block.column(0).to_pylist()
            found = []
            for text, draw, spans in zip(texts, block.column(1).to_pylist(), base_spans(texts, *laid_out(texts)), strict=True):
                found += [(bool(spans), draw, i, *w) for i, w in enumerate(windows(text, spans, draw))]
            columns = zip(*found, strict=True) if found else [()] * 5
            kinds = (pa.bool_(), pa.int64(), pa.int32(), pa.string(), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=["labelled", "draw", "i", "text", "spans"])

    cuts = rows.where(chosen).select("text", "draw").mapInArrow(cut, "labelled boolean, draw long, i int, text string, spans array<int>")
    # equal rows have equal hashes, so the bound is set once more
    order = (F.shiftrightunsigned("draw", 11), "draw", "i", "text")
    got = [r for flag in (True, False) for r in cuts.where(F.col("labelled") == flag).orderBy(*order).limit(sample * WINDOWS).collect()]
    return fit([(r["text"], list(r["spans"])) for r in got])


def find_in(texts: list[str], field: Field, known: WordFeatures) -> list[list[tuple[int, int, int]]]:
    """Per text all spans in order: start, place of the kind, end."""
    codes, begins = laid_out(texts)
    base = base_spans(texts, codes, begins)
    tokens = Tokens.of(texts, codes, begins)
    scores = field.emissions(tokens, known)
    scores[:, OUTSIDE] += LEAD
    starts, stops = spans_of(field.decode(scores, tokens.first))
    out = [[s[:3] for s in spans] for spans in base]
    of = np.searchsorted(tokens.first, starts, side="right") - 1
    for i, a, b in zip(of.tolist(), (tokens.starts[starts] - begins[of]).tolist(), (tokens.ends[stops] - begins[of]).tolist(), strict=True):
        if b - a >= CRF_CHARS and not any(a < end and begin < b for begin, _, end, _, _ in base[i]):
            out[i].append((a, 3, b))
    return [sorted(x) for x in out]


def find_secrets(docs: DataFrame, field: Field | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of docs with its secrets: id_col, spans (array of kind, start, end in code points, by start and kind).

    Base spans always stay; the field adds spans of at least CRF_CHARS that meet none of them, of kind crf. A null text counts as empty
    and has none. Repeated rows and null ids come back as they are, an empty table gives no rows; very long texts are read whole. Only
    id_col and text_col are read, so no other column can clash. Without a field one is fitted on docs.
    """
    field = field or train(docs, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(field)  # of fixed size

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordFeatures(shared.value.names)
        kind = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
        for block in blocks(batches, "_text"):
            found = find_in([t or "" for t in block.column(1).to_pylist()], shared.value, known)
            rows = [[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in spans] for spans in found]
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array(rows, pa.list_(kind))], names=[id_col, "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col), F.col(text_col).alias("_text"))
    return rows.mapInArrow(run, f"`{id_col}` {kind}, spans array<struct<kind:string,start:int,end:int>>")


def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts, their digest and all spans of every document."""
    found = find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.filter("spans", lambda s: s["kind"] != "crf")
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, KINDS[:3]), F.sha2(written(base).cast("binary"), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
