"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes for what they miss."""

from __future__ import annotations

import functools
import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausegraph.llm.common import spread_rows

KINDS = ("email", "ip", "card", "phone")
#: States: outside, then begin and inside of every kind.
STATES = ["O", *[f"{p}-{k}" for k in KINDS for p in "BI"]]

# -- the fixed patterns ------------------------------------------------------------------------------------------------

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")  # a match can only begin where a number does
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")


def digits_of(text: str) -> str:
    return "".join(DIGIT.findall(text))


def luhn(digits: str) -> bool:
    """The check of 13 to 19 digits."""
    if not 13 <= len(digits) <= 19:
        return False
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def ip_parts(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in text.split("."))


def emails(text: str) -> list[tuple[int, int]]:
    """Matches of the mail pattern.  Each is looked for around its ``@``: the name before it has no other, so this finds the same."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            out.append((start, domain.end()))
        done = domain.end() if domain else at + 1
        at = text.find("@", done)
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(kind number, start, end)`` of the fixed patterns: leftmost matches of each kind that do not overlap; failing ones are dropped."""
    out = [(0, a, b) for a, b in emails(text)]
    if DIGIT.search(text):
        out += [(1, m.start(), m.end()) for m in IP.finditer(text) if ip_parts(m.group())]
        out += [(2, m.start(), m.end()) for m in CARD.finditer(text) if m.end() - m.start() >= 13 and luhn(digits_of(m.group()))]
        if "+" in text:
            out += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(digits_of(m.group())) <= 15]
    return out


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


# -- the labelled table ------------------------------------------------------------------------------------------------

#: Sentences with places to fill in: those named like a kind are labelled as one, the others are not personal data.
LABELLED = [
    "please call {phone} today", "phone {phone}", "my number is {phone} and his is {phone}", "fax: {phone}, office {phone}",
    "tel. {phone} or write to {email}", "reach me at {email}", "mail {email} for details", "contact {email}, {phone}",
    "send it to {email} by {date}", "{email} wrote on {date}", "from {email} to {email}", "{email} {phone}", "{phone} {card}", "{ip} {card}",
    "{card} {phone}", "{card} {ip}", "{email} {card}", "{phone} {ip}", "{ip} {phone}", "{ip} {ip}", "{card} {card}", "{phone} {phone}",
    "word {ip} word", "server {ip} is down", "login from {ip} at {time}", "host {ip} port {count}", "card {card} was charged {price}",
    "visa {card}", "pay with {card} please", "word {card} word", "word {phone} word", "word {email} word", "word {phone} {card} word",
    "word {ip} {card} {phone} word", "order {count} of {date}", "version {version} of {date}", "it costs {price}", "page {count} of {count}",
    "section {section} says {count} words", "room {count}, floor {count}", "key {hex} and {hex}", "password={hex}", "commit {hex}",
    "in {year} and {year}", "{year} to {year}", "total {price} for {count}", "at {time} on {date}", "invoice {long} paid {price}",
    "serial {long}", "{count} {count} {count}", "table {section} lists {count}", "id {long} {count}", "see {section} and {section}",
    "user@ {count}", "@name {count}", "word {version} word", "word {count} word {long}", "token = {hex}", "{date} {time} {count}",
]
#: Rows that are filled in for each sentence.
FILLS = 12
SEED = 7


def filled(name: str, rng: random.Random) -> str:
    """One value of a place; the forms of the kinds go beyond the fixed patterns."""
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randint(3, 8)))
    if name == "phone":
        a, b, c = rng.choice("23456789") + number(2), number(3), number(4)
        return rng.choice([f"+1 ({a}) {b}-{c}", f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+1 {a} {b} {c}", f"+1-{a}-{b}-{c}",
                           f"+{rng.randint(20, 99)} {a} {b} {c}", f"00{rng.randint(20, 99)} {a} {b}{c}"])
    if name == "email":
        user = word() + rng.choice(["", ".", "_"]) + rng.choice([word(), number(2)])
        host, end = word() + rng.choice(["", number(1)]), rng.choice(["com", "org", "net", "de"])
        return rng.choice([f"{user}@{host}.example.{end}", f"{user}@{host}.{end}", f"{user} [at] {host} [dot] {end}", f"{user}(at){host}(dot){end}",
                           f"{user} (at) {host}.{end}", f"{user}[at]{host}.{end}", f"{user} @ {host}.{end}", f"{user} [at] {host}.{end}"])
    if name == "ip":
        parts = [str(rng.randint(1, 255)) for _ in range(4)]
        return rng.choice([".".join(parts), ".".join(parts), "[.]".join(parts), "(.)".join(parts), ".".join(parts) + f":{rng.randint(80, 9000)}",
                           "[dot]".join(parts)])
    if name == "card":
        body = "4" + number(14)
        card = next(body + d for d in "0123456789" if luhn(body + d))
        groups = [card[i: i + 4] for i in range(0, 16, 4)]
        return rng.choice([card, card, " ".join(groups), "-".join(groups), ".".join(groups)])
    if name == "long":
        size = rng.choice([7, 8, 10, 11, 12, 14, 16, 20])
        body = number(size - 1)
        return next(body + d for d in "1234567890" if not luhn(body + d))
    plain = {"count": number(rng.randint(1, 4)), "year": f"{rng.choice(['19', '20'])}{number(2)}", "time": f"{rng.randint(0, 23)}:{number(2)}",
             "date": rng.choice([f"{number(4)}-{number(2)}-{number(2)}", f"{rng.randint(1, 28)}.{rng.randint(1, 12)}.{number(4)}", f"{number(2)}/{number(2)}/{number(4)}"]),
             "price": rng.choice([f"${number(3)}.{number(2)}", f"{number(2)},{number(3)}", f"{number(2)}.{number(2)}"]),
             "version": rng.choice([f"{number(1)}.{number(1)}.{number(2)}", f"v{number(1)}.{number(2)}", f"{number(1)}.{number(2)}"]),
             "section": rng.choice([f"{number(1)}.{number(1)}", f"§{number(2)}", f"({number(1)})", f"{number(1)}.{number(1)}.{number(1)}"]),
             "hex": "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice([18, 32, 40])))}
    return plain[name]


def labelled_rows() -> list[tuple[str, list[tuple[int, int, int]]]]:
    """The labelled table: text and ``(kind number, start, end)`` of its personal data."""
    rng = random.Random(SEED)
    rows = []
    for template in LABELLED:
        for _ in range(FILLS):
            text, spans = "", []
            for i, part in enumerate(re.split(r"[{}]", template)):
                value = filled(part, rng) if i % 2 else re.sub("word", lambda _: "".join(rng.choice("aehinorst") for _ in range(rng.randint(2, 9))), part)
                if i % 2 and part in KINDS:
                    spans.append((KINDS.index(part), len(text), len(text) + len(value)))
                text += value
            rows.append((text, spans))
    return rows


# -- tokens and their features -----------------------------------------------------------------------------------------

TOKEN = re.compile(r"\S+")
MARK = re.compile(r"[\[({](?:at|dot|@|\.)[\])}]", re.IGNORECASE)
#: Only tokens with a digit, an ``@`` or a written ``at``/``dot``, and the neighbours of such a mark or of a lone ``@``, can be personal data.
ASKED = re.compile(r"[0-9@]|[\[({](?:at|dot)[\])}]", re.IGNORECASE)
LONE = re.compile(r"@|[\[({](?:at|dot)[\])}]", re.IGNORECASE)
EDGES = ".,;:!?\"'"
_SHAPE = re.compile(r"[0-9]+|[A-Z]+|[a-z]+|[^\x00-\x7F]+")


def shape(token: str, exact: bool = True) -> str:
    """Digits become ``d`` (with their number if ``exact``), letters ``X`` or ``x``; runs are drawn together."""
    def part(match: re.Match) -> str:
        first = match.group()[0]
        if first.isdigit() and first.isascii():
            return f"d{min(match.end() - match.start(), 20)}" if exact else "d"
        return "u" if ord(first) > 127 else "X" if first.isupper() else "x"

    return _SHAPE.sub(part, token[:80])


@functools.lru_cache(1 << 14)
def own_features(token: str) -> tuple[str, ...]:
    core = token.strip(EDGES)
    digits = digits_of(core[:80])
    found = [f"s={shape(core)}", f"c={shape(core, False)}", f"n={min(len(digits), 20)}", f"e={token[-1:] if token[-1:] in EDGES else ''}"]
    if MARK.search(core):
        found.append("mark")
    if "@" in core:
        found.append("at")
    if luhn(digits) and core.replace("-", "").replace(".", "").isdigit():
        found.append("luhn")
    if IP.fullmatch(core) and ip_parts(core):
        found.append("ip")
    return tuple(found)


@functools.lru_cache(1 << 14)
def side_features(token: str) -> tuple[str, ...]:
    core = token.strip(EDGES)
    return f"c={shape(core, False)}", f"n={min(len(digits_of(core[:80])), 20)}", f"w={core.lower()[:12]}" if len(core) <= 12 and core.isalpha() else "w="


def features(tokens: list[str], at: int) -> list[str]:
    found = ["bias", *own_features(tokens[at])]
    for step in (-2, -1, 1, 2):
        side = side_features(tokens[at + step]) if 0 <= at + step < len(tokens) else ("end",)
        found += [f"{step}{f}" for f in (side if abs(step) == 1 else side[:2])]
    return found


def open_tokens(tokens: list[str]) -> list[bool]:
    """Which tokens can be something other than outside."""
    asked = [ASKED.search(t) is not None for t in tokens]
    lone = [a and LONE.search(t) is not None and (t[0] in "@[({" or t[-1] in "@])}") for a, t in zip(asked, tokens, strict=True)]
    return [a or (i > 0 and lone[i - 1]) or (i + 1 < len(lone) and lone[i + 1]) for i, a in enumerate(asked)]


# -- the conditional random field --------------------------------------------------------------------------------------

BARRED = -1e9


def allowed() -> np.ndarray:
    """0 for possible steps between states; an inside follows a begin or inside of its kind only."""
    out = np.zeros((len(STATES), len(STATES)))
    for b, name in enumerate(STATES):
        if name.startswith("I-"):
            for a, before in enumerate(STATES):
                if before == "O" or before[2:] != name[2:]:
                    out[a, b] = BARRED
    return out


class ShapeField:
    """Weights of features and of steps between states.  What stands before and after a sequence is outside."""

    def __init__(self, names: dict[str, int], weights: np.ndarray, steps: np.ndarray) -> None:
        self.names, self.weights, self.steps = names, weights, steps + allowed()

    def emissions(self, runs: list[list[list[str]]]) -> np.ndarray:
        """(runs, longest, states) scores of the tokens of each run, zero beyond its end."""
        longest = max(map(len, runs))
        out = np.zeros((len(runs), longest, len(STATES)))
        ids = [[self.names[f] for f in token if f in self.names] for run in runs for token in run]
        place = np.array([i * longest + j for i, run in enumerate(runs) for j in range(len(run))])
        flat = np.array([f for token in ids for f in token], np.int64)
        np.add.at(out.reshape(-1, len(STATES)), np.repeat(place, [len(t) for t in ids]), self.weights[flat])
        return out

    def decode(self, runs: list[list[list[str]]]) -> list[list[int]]:
        """The best states of every run: Viterbi, all runs of a batch advance together, longer ones go on alone."""
        order = sorted(range(len(runs)), key=lambda i: -len(runs[i]))
        out: list[list[int]] = [[] for _ in runs]
        at = 0
        while at < len(order):  # one table for runs of like length, so that a long run does not pad the others
            stop = at + 1
            while stop < len(order) and 2 * len(runs[order[stop]]) >= len(runs[order[at]]) and stop - at < 4096:
                stop += 1
            part = order[at:stop]
            sizes = np.array([len(runs[i]) for i in part])
            scores = self.emissions([runs[i] for i in part])
            best = self.steps[0] + scores[:, 0]
            back = np.zeros((scores.shape[1], len(part), len(STATES)), np.int8)
            last = np.where((sizes == 1)[:, None], best, 0)
            for step in range(1, scores.shape[1]):
                live = int(np.searchsorted(-sizes, -step, side="left"))  # runs longer than ``step``
                reach = best[:live, :, None] + self.steps
                back[step, :live] = reach.argmax(1)
                best = reach.max(1) + scores[:live, step]
                ends = sizes[:live] == step + 1
                last[:live][ends] = best[ends]
            state = (last + self.steps[:, 0]).argmax(1)
            for row, i in enumerate(part):
                now, path = int(state[row]), []
                for step in range(len(runs[i]) - 1, -1, -1):
                    path.append(now)
                    now = int(back[step, row, now])
                out[i] = path[::-1]
            at = stop
        return out


@functools.lru_cache(1)
def train(rounds: int = 120, rate: float = 0.15, decay: float = 1e-3) -> ShapeField:
    """Weights of the largest penalised likelihood over the labelled table: forward and backward sums, Adam steps.  Same on every run."""
    runs, states = [], []
    for text, spans in labelled_rows():
        for own, path in labelled_runs(text, spans):
            runs.append(own)
            states.append(path)
    names = {f: i for i, f in enumerate(sorted({f for run in runs for token in run for f in token}))}
    longest, count, width = max(map(len, runs)), len(runs), len(STATES)
    sizes = np.array(list(map(len, runs)))
    inside = np.arange(longest)[None, :] < sizes[:, None]
    owner = np.array([i * longest + j for i, run in enumerate(runs) for j, token in enumerate(run) for _ in token])
    flat = np.array([names[f] for run in runs for token in run for f in token])
    gold = np.zeros((count, longest, width))
    pairs = np.zeros((width, width))
    for i, path in enumerate(states):
        for j, s in enumerate(path):
            gold[i, j, s] = 1
        for a, b in zip([0, *path], [*path, 0], strict=True):
            pairs[a, b] += 1
    weights, steps = np.zeros((len(names), width)), np.zeros((width, width))
    moments = [np.zeros_like(x) for x in (weights, weights, steps, steps)]
    bars = allowed()
    rows = np.arange(count)

    def add(x: np.ndarray, axis: int) -> np.ndarray:
        top = x.max(axis, keepdims=True)
        return (np.log(np.exp(x - top).sum(axis, keepdims=True)) + top).squeeze(axis)

    for turn in range(1, rounds + 1):
        moves = steps + bars
        scores = np.zeros((count * longest, width))
        np.add.at(scores, owner, weights[flat])
        scores = scores.reshape(count, longest, width)
        ahead = np.zeros_like(scores)
        ahead[:, 0] = moves[0] + scores[:, 0]
        for j in range(1, longest):
            ahead[:, j] = add(ahead[:, j - 1][:, :, None] + moves, 1) + scores[:, j]
        behind = np.zeros_like(scores)
        for j in range(longest - 1, -1, -1):
            ends = (sizes == j + 1)[:, None]
            onward = add(moves + (scores[:, j + 1] + behind[:, j + 1])[:, None, :], 2) if j + 1 < longest else moves[:, 0][None, :]
            behind[:, j] = np.where(ends, moves[:, 0][None, :], onward)
        whole = add(ahead[rows, sizes - 1] + moves[:, 0], 1)
        share = np.exp(ahead + behind - whole[:, None, None]) * inside[:, :, None]
        expected = np.zeros((width, width))
        expected[0] += share[:, 0].sum(0)
        expected[:, 0] += share[rows, sizes - 1].sum(0)
        for j in range(1, longest):
            both = ahead[:, j - 1][:, :, None] + moves + (scores[:, j] + behind[:, j])[:, None, :] - whole[:, None, None]
            expected += (np.exp(np.minimum(both, 0)) * inside[:, j][:, None, None]).sum(0)
        slope = np.zeros_like(weights)
        np.add.at(slope, flat, (gold - share).reshape(-1, width)[owner])
        for now, slope_now, at in ((weights, slope / count - decay * weights, 0), (steps, (pairs - expected) / count - decay * steps, 2)):
            moments[at] = 0.9 * moments[at] + 0.1 * slope_now
            moments[at + 1] = 0.99 * moments[at + 1] + 0.01 * slope_now**2
            now += rate * (moments[at] / (1 - 0.9**turn)) / (np.sqrt(moments[at + 1] / (1 - 0.99**turn)) + 1e-8)
    return ShapeField(names, weights, steps)


def token_runs(text: str) -> Iterator[tuple[list[tuple[int, int]], list[list[str]]]]:
    """``(places, features)`` of each stretch of neighbouring tokens that can be personal data.

    All other tokens are outside for certain, and given such a token the best states to its left and right do not
    depend on each other: decoding the stretches decodes the whole text.
    """
    if not ASKED.search(text):
        return
    places = [m.span() for m in TOKEN.finditer(text)]
    tokens = [text[a:b] for a, b in places]
    can = open_tokens(tokens)
    at = 0
    while at < len(tokens):
        if not can[at]:
            at += 1
            continue
        stop = at
        while stop < len(tokens) and can[stop]:
            stop += 1
        yield places[at:stop], [features(tokens, i) for i in range(at, stop)]
        at = stop


def labelled_runs(text: str, spans: list[tuple[int, int, int]]) -> Iterator[tuple[list[list[str]], list[int]]]:
    for places, own in token_runs(text):
        path = []
        for a, b in places:
            kind, start = next(((k, s) for k, s, e in spans if s < b and a < e), (-1, 0))
            path.append(0 if kind < 0 else 1 + 2 * kind + (a > start))
        yield own, path


# -- spans that the field adds -----------------------------------------------------------------------------------------

_AT, _DOT = re.compile(r"\s*[\[({]at[\])}]\s*|\s+@\s*|\s*@\s+", re.IGNORECASE), re.compile(r"\s*[\[({](?:dot|\.)[\])}]\s*", re.IGNORECASE)


def trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    """Without quotes and stops at the ends, and without a bracket that the span does not close or open."""
    while start < end and (text[start] in EDGES + "<>=" or text[start] in "([{" and not any(c in ")]}" for c in text[start:end])):
        start += 1
    while start < end and (text[end - 1] in EDGES + "<>=" or text[end - 1] in ")]}" and not any(c in "([{" for c in text[start:end])):
        end -= 1
    return start, end


def plausible(kind: int, value: str) -> bool:
    """A last look at what the field found: the value holds what its kind needs, in whatever form it is written."""
    if len(value) > 200:
        return False
    plain = _DOT.sub(".", value)
    if kind == 0:
        found = emails(_AT.sub("@", plain))
        return found == [(0, len(_AT.sub("@", plain)))]
    if kind == 1:
        plain = re.sub(r":[0-9]{1,5}\Z", "", plain)
        return IP.fullmatch(plain) is not None and ip_parts(plain)
    if kind == 2:
        return luhn(digits_of(value)) and not re.search(r"[^0-9 .-]", value)
    return 9 <= len(digits_of(value)) <= 15 and not re.search(r"[^0-9 .()+/-]", value)


def found_spans(text: str, places: list[tuple[int, int]], path: list[int]) -> Iterator[tuple[int, int, int]]:
    at = 0
    while at < len(path):
        stop = at + 1
        if path[at]:
            while stop < len(path) and path[stop] == path[at] + 1 and path[at] % 2:
                stop += 1
            start, end = trimmed(text, places[at][0], places[stop - 1][1])
            kind = (path[at] - 1) // 2
            if start < end and plausible(kind, text[start:end]):
                yield kind, start, end
        at = stop


def all_spans(texts: list[str], field: ShapeField) -> list[tuple[list, list]]:
    """``(base spans, added spans)`` of every text; a span that touches a base span is not added."""
    base = [base_spans(t) for t in texts]
    owners, places, runs = [], [], []
    for i, text in enumerate(texts):
        for where, own in token_runs(text):
            owners.append(i)
            places.append(where)
            runs.append(own)
    added: list[list] = [[] for _ in texts]
    for i, where, path in zip(owners, places, field.decode(runs) if runs else [], strict=True):
        for kind, start, end in found_spans(texts[i], where, path):
            if not any(start < b and a < end for _, a, b in base[i]):
                added[i].append((kind, start, end))
    return list(zip(base, added, strict=True))


def personal_data(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added, base_spans)``, one row per row of ``docs``.

    The fixed patterns give the base spans, whose list ``base_spans`` is digested as ``base_sha256``.  The field labels the tokens of the
    whole text and adds spans that the patterns miss (numbers that stand next to each other, other ways to write
    them); base spans stay.  The counts are those of all spans, ``n_added`` of them added ones.  The field is trained
    on the driver from ``labelled_rows`` alone, so a row's result depends on its text only.  Null and empty texts have
    no spans, repeated rows and null keys are judged alike, an empty table gives no rows, other columns are ignored.
    """
    kind = docs.schema[key].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(train())  # a few thousand weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = shared.value
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                texts: list[str] = []
                size = 0
                while at + len(texts) < batch.num_rows and size < 1 << 22:
                    texts.append(batch.column(1)[at + len(texts)].as_py() or "")
                    size += len(texts[-1])
                found = all_spans(texts, field)
                plain = [listed(base) for base, _ in found]
                counts = np.zeros((len(texts), len(KINDS)), np.int64)
                for i, (base, more) in enumerate(found):
                    for k, _, _ in base + more:
                        counts[i, k] += 1
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(texts)), *[pa.array(counts[:, k]) for k in range(len(KINDS))],
                     pa.array([hashlib.sha256(b.encode()).hexdigest() for b in plain], pa.string()),
                     pa.array([listed(base + more) for base, more in found], pa.string()), pa.array([len(more) for _, more in found], pa.int64()),
                     pa.array(plain, pa.string())],
                    ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_added", "base_spans"])
                at += len(texts)

    slim = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))
    schema = f"doc_id {kind}, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string, n_added long, base_spans string"
    return spread_rows(slim).mapInArrow(run, schema)
