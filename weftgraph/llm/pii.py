"""Personal data: fixed base patterns, and more spans by a semi-Markov conditional random field.

Base spans (email, ip, card, phone) are the matches of fixed patterns that pass their checks. The field
works on windows of tokens around every digit, at-sign and word that announces a password; outside them no
segment can be an entity, because a candidate must hold such a sign, a spelt-out one, or be announced. Windows
end at white space, so no token is cut, however long. Within a window it scores candidate segments of up to
``LONGEST`` tokens (a run of 40 or more key signs is one token) by features of the whole span (its digits,
separators, checksum, shape, what stands before it and at its edges) for each type, and the type of the segment
before; a dynamic programme over bounded segments chooses boundaries and types together. A long window is
decoded in steps of ``STEP`` tokens that look ``2 * LONGEST`` tokens ahead. Entities that overlap no base span
are added to the base spans, which always stay. Types: those of the base, ``secret`` (keys, tokens,
passwords) and ``ssn`` (numbers of three, two and four digits).

The field is trained here, by the likelihood of labelled windows that a seeded generator writes from rules:
all types in plain, spaced and spelt-out forms among look-alikes (dates, versions, times, sums, long numbers
that fail the checksum, hashes in file names, words with numbers). No text of the corpus is used.

Defined results: null counts as empty and gives no spans; positions are code points, ends exclusive; work is
linear in a text's length, whatever its signs; of equal scores the candidate met first stays; repeated rows are
read each; an empty table gives an empty result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import named, text_slices

KINDS = ("email", "ip", "card", "phone", "secret", "ssn")
BASE_KINDS = KINDS[:4]
SECRETS = KINDS.index("secret")
LONGEST = 14
REACH = 48
#: Tokens decoded at once.
STEP = 1_000

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k & 1:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches of the email pattern, found from each at-sign outwards."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
            at = text.find("@", done)
        else:
            at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of every base span, in order."""
    out = [(a, 0, b) for a, b in emails(text)]
    for m in IP.finditer(text):
        if all(len(p) < 4 and int(p) < 256 or int(p.lstrip("0")[:4] or 0) < 256 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if 12 <= m.end() - m.start() and 12 <= len(d := NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


TOKEN = re.compile(r"[A-Za-z0-9_+/=-]{40,}|[A-Za-z]+(?![A-Za-z0-9])|[A-Za-z0-9]+|[^\sA-Za-z0-9]|\n")
PASSWORD = r"(?i:password|passwd|pwd|passphrase|secret|token|key)"
ANCHOR = re.compile(r"[0-9@]\S*|\b" + PASSWORD + r"""["']? ?[:=]|[\[({<] ?(?:at|AT) ?[\])}>]|\b(?:at|AT)\b(?= [A-Za-z0-9-]+ (?:dot|DOT)\b)""")
SPELT = re.compile(r"[A-Za-z0-9._%+-]+(?: ?[\[({<] ?(?:at|AT) ?[\])}>] ?| (?:at|AT) | ?@ ?)[A-Za-z0-9-]+(?:(?: ?[\[({<] ?(?:dot|DOT) ?[\])}>] ?| (?:dot|DOT) | ?\. ?)[A-Za-z0-9-]+)+")
MAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
QUAD = re.compile(r"[0-9]{1,3}(?: ?(?:\.|\[\.\]) ?[0-9]{1,3}){3}")
NUMBERS = re.compile(r"[0-9](?:[\x20.-]?[0-9])+")
TELEPHONE = re.compile(r"(?:\+|00)?[0-9]{0,3}[\x20.-]?\(?[0-9]{2,4}\)?(?:[\x20.-]?[0-9]{2,4}){2,4}")
DATE = re.compile(r"[0-9]{1,4}[-/.][0-9]{1,2}[-/.][0-9]{1,4}|[0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?")
SECRET = re.compile(r"[A-Za-z0-9_+/=-]{10,}")
SSN = re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}")
ANNOUNCED = re.compile(PASSWORD + r"""["']? ?[:=] ?["']?\Z""")
SPACES = re.compile(r"\s")
CUES = (
    frozenset("email mail contact write reply address".split()),
    frozenset("ip host server address from node".split()),
    frozenset("card visa credit debit mastercard payment pan".split()),
    frozenset("phone tel telephone call mobile cell fax dial whatsapp".split()),
    frozenset("token secret key password passwd pwd apikey api auth bearer credential passphrase".split()),
    frozenset("ssn social security".split()),
    frozenset("date version release order invoice page section isbn on total item ref file commit".split()),
)


def span_features(text: str, tokens: list[tuple[int, int]], i: int, j: int, cue: list[int]) -> list[float]:
    """Of the segment of tokens i to j - 1."""
    a, b = tokens[i][0], tokens[j - 1][1]
    s = text[a:b]
    digits = NOT_DIGIT.sub("", s)
    n, letters = len(digits), sum(map(str.isalpha, s))
    before, after = text[a - 1 : a], text[b : b + 1]
    quad = QUAD.fullmatch(s) is not None
    parts_ok = quad and all(int(p) < 256 for p in re.findall("[0-9]+", s))
    numbers = NUMBERS.fullmatch(s) is not None
    secret = SECRET.fullmatch(s) is not None
    joined = before and (before.isalnum() or before in "._-@/+") or after and (after.isalnum() or after in "-@/_" or after == "." and text[b + 1 : b + 2].isalnum())
    return [
        1.0,
        float(bool(joined)),
        float(MAIL.fullmatch(s) is not None),
        float(SPELT.fullmatch(s) is not None),
        float(quad),
        float(parts_ok),
        float(numbers),
        float(numbers and 12 <= n <= 19),
        float(numbers and 12 <= n <= 19 and luhn(digits)),
        float(TELEPHONE.fullmatch(s) is not None),
        float(s[0] == "+"),
        float("(" in s),
        float(9 <= n <= 15),
        float(n in (7, 8)),
        float(n < 7),
        float(n > 19),
        float(DATE.fullmatch(s) is not None),
        float(secret),
        float(secret and n > 2 and letters > 2),
        float(secret and len(s) >= 20),
        float(letters == 0),
        float(n == 0),
        float(" " in s),
        float("." in s),
        (j - i) / 8,
        float(before in "\"'" and before == after and before != ""),
        float(SSN.fullmatch(s) is not None),
        float(n == 0 and ANNOUNCED.search(text, max(0, a - 14), a) is not None),
        *(float(c in cue) for c in range(len(CUES))),
    ]


@dataclass
class Window:
    """The tokens of a stretch of text and its candidate segments."""

    text: str
    tokens: list[tuple[int, int]]
    spans: list[tuple[int, int]]
    x: object


def window(text: str, a: int, b: int) -> Window:
    return window_of(text, [m.span() for m in TOKEN.finditer(text, a, b)])


def window_of(text: str, tokens: list[tuple[int, int]], before: list[tuple[int, int]] = ()) -> Window:
    """From tokens, and the few before them, which may be cues."""
    import numpy as np

    words = [text[p:q] for p, q in tokens]
    cues, recent = [], []
    for k, w in enumerate([*(text[p:q] for p, q in before), *words], -len(before)):
        if k >= 0:
            cues.append([c for _, c in recent])
        low = w.lower() if len(w) < 12 else ""
        recent = [(at, c) for at, c in recent if at > k - 4] + [(k, c) for c, names in enumerate(CUES) if low in names]
    sign = [w == "@" or any("0" <= c <= "9" for c in w) or w in ("at", "AT") for w in words]
    spans, x = [], []
    for i, w in enumerate(words):
        if not (w[0].isalnum() or w in "+("):
            continue
        plain = w.isalpha()
        joint = plain and i + 1 < len(words) and words[i + 1] in "-_+/" and tokens[i + 1][0] == tokens[i][1]
        held = plain and len(w) >= 8 and 4 in cues[i] and ANNOUNCED.search(text, max(0, tokens[i][0] - 14), tokens[i][0]) is not None
        announced = held
        for j in range(i + 1, min(i + LONGEST, len(words)) + 1):
            last = words[j - 1]
            if last == "\n":
                break
            held = held or sign[j - 1]
            mail = plain and not any(v in ("@", "at", "AT") for v in words[i + 1 : j])
            if not held or not (last[-1].isalnum() or last[-1] == "=" and len(last) > 1):
                continue
            if mail and not (j == i + 1 and (announced or len(w) >= 10 and not plain) or joint and SECRET.fullmatch(text, tokens[i][0], tokens[j - 1][1])):
                continue
            spans.append((i, j))
            x.append(span_features(text, tokens, i, j, cues[i]))
    return Window(text, tokens, spans, np.array(x).reshape(len(spans), N_FEATURES))


N_FEATURES = 28 + len(CUES)


@dataclass
class Field:
    """weights(type, feature) of segments, moves(type before, type); type 0 is a token outside, of score 0."""

    weights: object
    moves: object

    def _lattice(self, w: Window):
        ends: list[list[int]] = [[] for _ in range(len(w.tokens) + 1)]
        for k, (_, j) in enumerate(w.spans):
            ends[j].append(k)
        return ends, (w.x @ self.weights.T if len(w.spans) else w.x[:, :0])

    def decode(self, w: Window) -> list[tuple[int, int, int]]:
        """(start, kind, end) of the best segmentation's entities."""
        import numpy as np

        if not w.spans:
            return []
        ends, score = self._lattice(w)
        n, types = len(w.tokens), len(KINDS) + 1
        best = np.full((n + 1, types), -np.inf)
        best[0, 0] = 0
        back: list[dict[int, tuple[int, int]]] = [{} for _ in range(n + 1)]
        for j in range(1, n + 1):
            step = best[j - 1] + self.moves[:, 0]
            best[j, 0] = step.max()
            back[j][0] = (j - 1, int(step.argmax()))
            for k in ends[j]:
                i = w.spans[k][0]
                arrive = best[i][:, None] + self.moves[:, 1:]
                value = arrive.max(0) + score[k]
                for y in np.flatnonzero(value > best[j, 1:]):
                    best[j, y + 1] = value[y]
                    back[j][y + 1] = (i, int(arrive[:, y].argmax()))
        out, j, y = [], n, int(best[n].argmax())
        while j:
            i, before = back[j][y]
            if y:
                out.append((w.tokens[i][0], y - 1, w.tokens[j - 1][1]))
            j, y = i, before
        return out[::-1]

    def gradient(self, w: Window, truth: list[tuple[int, int, int]]):
        """Observed less expected features and moves, truth as (token i, kind, token j)."""
        import numpy as np

        ends, score = self._lattice(w)
        n, types = len(w.tokens), len(KINDS) + 1
        fore, aft = np.full((n + 1, types), -np.inf), np.full((n + 1, types), -np.inf)
        fore[0, 0] = 0
        arrive = np.full((n + 1, types), -np.inf)
        for j in range(n + 1):
            if j:
                fore[j, 0] = arrive[j - 1, 0]
                if ends[j]:
                    fore[j, 1:] = np.logaddexp.reduce(arrive[[w.spans[k][0] for k in ends[j]], 1:] + score[ends[j]], 0)
            arrive[j] = np.logaddexp.reduce(fore[j][:, None] + self.moves, 0)
        total = np.logaddexp.reduce(fore[n])
        aft[n] = 0
        leave = np.full((n + 1, types), -np.inf)  # by type of the segment that starts there
        for i in range(n, -1, -1):
            if i < n:
                aft[i] = np.logaddexp.reduce(self.moves + leave[i][None, :], 1)
            if i:
                leave[i - 1, 0] = np.logaddexp(leave[i - 1, 0], aft[i, 0])
                for k in ends[i]:
                    a = w.spans[k][0]
                    leave[a, 1:] = np.logaddexp(leave[a, 1:], score[k] + aft[i, 1:])
        dw, dm = np.zeros_like(self.weights), np.zeros_like(self.moves)
        if w.spans:
            at = np.array(w.spans)
            p = np.exp(arrive[at[:, 0], 1:] + score + aft[at[:, 1], 1:] - total)
            dw -= p.T @ w.x
        with np.errstate(invalid="ignore"):
            dm -= np.exp(fore[:n, :, None] + self.moves + leave[:n, None, :] - total).sum(0)
        place = {s: k for k, s in enumerate(w.spans)}
        at, before = 0, 0
        for i, y, j in [*truth, (n, None, n)]:
            for _ in range(at, i):
                dm[before, 0] += 1
                before = 0
            if y is not None:
                dw[y] += w.x[place[i, j]]
                dm[before, y + 1] += 1
                at, before = j, y + 1
        return dw, dm


def example(draw) -> tuple[str, list[tuple[int, int, int]]]:
    """One labelled text: words, entities and look-alikes."""
    word = lambda: "".join(draw.choice(list("abcdefghilmnoprstuv"), draw.integers(2, 9)))
    digits = lambda n: "".join(map(str, draw.integers(0, 10, n)))
    pick = lambda *options: options[draw.integers(len(options))]

    def card(good: bool) -> str:
        while luhn(d := pick("4", "5", "6", "3") + digits(15)) != good:
            pass
        return pick(d, " ".join(d[k : k + 4] for k in (0, 4, 8, 12)), "-".join(d[k : k + 4] for k in (0, 4, 8, 12))) if good else d

    def entity(kind: int) -> tuple[str, str]:
        host = [word(), pick("com", "org", "net", "example.com")]
        user = pick(word(), f"{word()}.{digits(2)}", f"{word()}_{word()}")
        octets = [str(x) for x in draw.integers(0, 256, 4)]
        hexes = "".join(draw.choice(list("0123456789abcdef"), draw.integers(16, 41)))
        mixed = "".join(draw.choice(list("ABCDEFGHabcdefgh0123456789"), draw.integers(16, 33)))
        area, line = digits(3), (digits(3), digits(4))
        named = pick(word(), f"{word()}.{word()}", f"{word()}_{digits(2)}", f"{word()}-{word()}")
        groups = "-".join("".join(draw.choice(list("0123456789abcdef"), n)) for n in (8, 4, 4, 4, 11)) + digits(1)
        if kind == 4 and draw.random() < 0.2:
            return pick("password = ", "passwd: ", "pwd=", 'password: "', "passphrase = '"), word() + word() + "word"
        return [
            (pick("", "mail ", "contact "), pick(f"{user}@{host[0]}.{host[1]}", f"{named} at {host[0]} dot {pick('com', 'org')}", f"{named} [at] {host[0]} [dot] com", f"{named}(at){host[0]}(dot)org")),
            (pick("", "from ", "server "), pick(".".join(octets), "[.]".join(octets))),
            (pick("", "card ", "visa "), card(True)),
            (pick("", "call ", "phone: "), pick(f"+1 ({area}) {line[0]}-{line[1]}", f"({area}) {line[0]}-{line[1]}", f"+{digits(2)} {area} {line[0]} {line[1]}", f"{area}-{line[0]}-{line[1]}")),
            (pick("token = ", "password=", "api key: ", "secret ", "key "), pick(hexes + "7f", mixed + "a1", f'"{hexes}4e"', f"{pick('sk', 'pk', 'key')}-{mixed}7a", f"{pick('ghp', 'tok')}_{mixed}9b", groups)),
            (pick("", "ssn ", "social security "), f"{digits(3)}-{digits(2)}-{digits(4)}"),
        ][kind]

    def decoy() -> str:
        return pick(
            card(False), f"{draw.integers(1900, 2030)}-{draw.integers(10, 13)}-{draw.integers(10, 29)}", f"{digits(2)}:{digits(2)}", f"version {digits(1)}.{digits(1)}.{digits(2)}",
            f"order {digits(8)}", f"{digits(3)}.{digits(2)}", f"${digits(4)}", f"{draw.integers(256, 999)}.{digits(2)}.{digits(3)}.{digits(2)}", f"@ {word()}", f"at {word()}", f"{digits(2)}", f"commit {word()}{digits(1)}", digits(20), f"page {digits(3)}",
            f"{word()}-{digits(2)}", f"{word()}-{word()}-{digits(1)}", f"{pick('key', 'token', 'secret', 'password')} {word()}{word()}", f"{word()}{digits(2)}",
        )

    text, spans = "", []
    for _ in range(draw.integers(2, 5)):
        text += " ".join(word() for _ in range(draw.integers(1, 4))) + " "
        if draw.random() < 0.6:
            kind = int(draw.integers(len(KINDS)))
            cue, found = entity(kind)
            text += cue
            quoted = found[0] == '"'
            spans.append((len(text) + quoted, kind, len(text) + len(found) - quoted))
            text += found
        else:
            text += decoy()
        text += pick(" ", ", ", ". ")
    return text, spans


def train(examples: int = 480, epochs: int = 12, seed: int = 5, rate: float = 0.5, ridge: float = 0.002) -> Field:
    """Adagrad on the log-likelihood of generated windows."""
    import numpy as np

    draw = np.random.default_rng(seed)
    known = []
    for _ in range(examples):
        text, spans = example(draw)
        w = window(text, 0, len(text))
        starts, ends = {a: k for k, (a, _) in enumerate(w.tokens)}, {b: k + 1 for k, (_, b) in enumerate(w.tokens)}
        truth = [(starts.get(a), y, ends.get(b)) for a, y, b in spans]
        if all((i, j) in w.spans for i, _, j in truth):
            known.append((w, truth))
    types = len(KINDS) + 1
    field = Field(np.zeros((len(KINDS), N_FEATURES)), np.zeros((types, types)))
    sw, sm = np.full_like(field.weights, 1e-2), np.full_like(field.moves, 1e-2)
    for _ in range(epochs):
        for k in draw.permutation(len(known)):
            dw, dm = field.gradient(*known[k])
            dw -= ridge * field.weights
            dm -= ridge * field.moves
            sw += dw**2
            sm += dm**2
            field.weights = field.weights + rate * dw / np.sqrt(sw)
            field.moves = field.moves + rate * dm / np.sqrt(sm)
    return field


def windows(text: str) -> Iterator[tuple[int, int]]:
    """Stretches around all anchors, cut at white space; near ones are one."""
    a = b = -1
    for m in ANCHOR.finditer(text):
        if m.end() + REACH <= b:
            continue
        low = max(0, m.start() - REACH)
        if low > b:  # back to where the token at the edge begins, but not into the stretch before
            low = max(b, 0, *(text.rfind(x, max(b, 0), low) + 1 for x in " \n\t\r"))
        high = SPACES.search(text, min(len(text), m.end() + REACH))
        high = high.start() if high else len(text)
        if b >= low and a >= 0:
            b = high
            continue
        if b >= 0:
            yield a, b
        a, b = low, high
    if b >= 0:
        yield a, b


def overlaps(spans: list[tuple[int, int, int]], start: int, end: int, kinds: int = len(BASE_KINDS)) -> bool:
    """Whether any of the spans, in order of start and of so many kinds, reaches into start to end."""
    from bisect import bisect_left

    # Spans of one kind are disjoint, so few that begin before can still be open; the nearest of each kind decide.
    k, seen = bisect_left(spans, (end, -1, -1)) - 1, set()
    while k >= 0 and len(seen) < kinds:
        a, kind, b = spans[k]
        if b > start:
            return True
        seen.add(kind)
        k -= 1
    return False


def all_spans(text: str, field: Field) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(start, kind, end) of the base spans, and of base and added ones together."""
    from itertools import islice

    base = base_spans(text)
    added, kinds = [], len({y for _, y, _ in base})
    for a, b in windows(text):
        rest = (m.span() for m in TOKEN.finditer(text, a, b))
        tokens, before = list(islice(rest, STEP + 2 * LONGEST)), []
        while tokens:  # a long stretch is decoded in steps that look ahead
            done = len(tokens) if len(tokens) <= STEP else STEP
            end = tokens[done - 1][1]
            for s, y, e in field.decode(window_of(text, tokens, before)):
                if s < end:
                    if not overlaps(base, s, e, kinds):
                        added.append((s, y, e))
                    while done < len(tokens) and tokens[done][0] < e:
                        done += 1
            before = tokens[max(0, done - 4) : done]
            tokens = tokens[done:] + list(islice(rest, done))
    return base, sorted(base + added)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[y]}:{a}:{b}" for a, y, b in spans)


def span_report(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans, n_spans (all), n_secret for every row."""

    def run(batches: Iterator) -> Iterator:
        import hashlib

        import pyarrow as pa

        for batch in batches:
            for part in text_slices(batch, "text"):
                found = [all_spans(t or "", field) for t in part.column("text").to_pylist()]
                counts = [pa.array([sum(y == k for _, y, _ in base) for base, _ in found], pa.int64()) for k in range(len(BASE_KINDS))]
                more = [pa.array([len(x) for _, x in found], pa.int64()), pa.array([sum(y == SECRETS for _, y, _ in x) for _, x in found], pa.int64())]
                digest = pa.array([hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in found])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *counts, digest, pa.array([joined(x) for _, x in found]), *more], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_spans", "n_secret"])

    rows = docs.select(named(id_col).cast("long").alias("doc_id"), named(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long, n_secret long")
