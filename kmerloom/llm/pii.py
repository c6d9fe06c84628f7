"""PII spans: exact patterns, and what a character-level BiLSTM-CRF finds beyond them.

The tagger is trained in numpy on labelled spans (bounded by TRAINING): personal data in plain, in disguised and in
spelled-out forms, written by a seeded rule among words, numbers and codes that are none, and among stretches of documents,
whose own base spans are labelled too. Its weights are kept beside this module; `python -m kmerloom.llm.pii DOCUMENTS.parquet`
trains and writes them anew. It reads every character of every text, in overlapping windows. Each window is decoded; a
text's spans are reconciled globally: of the spans that its windows show, those stay that don't overlap and weigh most
together, if an exact check finds in them what their kind must have (see holds()).
"""

from __future__ import annotations

import bisect
import hashlib
import re
import string
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kmerloom.llm.bilstm_crf import Tagger
from kmerloom.llm.common import in_chunks

FOUND = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
KINDS = ("email", "ip", "card", "phone")

# The base patterns.
LOCAL = frozenset(string.ascii_letters + string.digits + "._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")

Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> Iterator[Span]:
    """The leftmost matches of a local part, an at sign and a dotted domain, found from the at signs."""
    done = 0
    at = text.find("@")
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in LOCAL:
            begin -= 1
        domain = DOMAIN.match(text, at + 1) if begin < at else None
        if domain:
            done = domain.end()
            yield begin, done, "email"
        else:
            done = max(done, at + 1)  # no match can reach over this sign
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[Span]:
    """All base spans, by start, then by kind in the order of KINDS."""
    found = list(emails(text)) if "@" in text else []
    if DIGIT.search(text):
        found += [(m.start(), m.end(), "ip") for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), m.end(), "card"))
        if "+" in text:
            found += [(m.start(), m.end(), "phone") for m in PHONE.finditer(text) if 10 <= sum(c in string.digits for c in m[0]) <= 15]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


# The tagger.

CHARS = {c: i + 2 for i, c in enumerate(string.ascii_lowercase + string.ascii_uppercase + string.digits + string.punctuation + " \t\n\r")}
N_CHARS = len(CHARS) + 3
OTHER_LETTER = N_CHARS - 1
TAGS = ["O", *(f"{p}-{k}" for k in KINDS for p in "BI")]
TRAINING, EPOCHS, HIDDEN = 9000, 10, 18
#: Documents that training takes stretches of, at most.
HOSTS = 400
WEIGHTS = Path(__file__).with_name("pii_weights.npz")
#: A window's characters, and where the next one begins: every span of up to WINDOW - STRIDE characters stands whole in a window.
WINDOW, STRIDE, CONFIDENT = 768, 672, 0.5
NUMBERS = "zero one two three four five six seven eight nine".split()
#: Words that stand around personal data and that are none themselves.
PLAIN = "the of and at on dot in to is a for mail me please call phone write or by meet look point server card number contact us now today from with see page visit home comma tonight thanks more works down was used her his my number fax tel dial reach server visa or ask they write".split()


NAMES = "bob anna john kim lisa jane mary jones doe lee smith klein rossi mail host site example company yahoo gmail posteo info sales admin support office team web shop cloud data home world north river green maria peter thomas laura brown martin garcia weber dubois store online music travel health studio group service global central".split()


@lru_cache(maxsize=1)
def char_table() -> np.ndarray:
    """The id of every code point."""
    table = np.array([OTHER_LETTER if chr(i).isalpha() else 1 for i in range(0x110000)], np.int32)
    table[[ord(c) for c in CHARS]] = list(CHARS.values())
    return table


def char_ids(text: str) -> np.ndarray:
    return char_table()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]


def training(n: int = TRAINING, seed: int = 7, hosts: tuple[str, ...] = ()) -> list[tuple[str, list[Span]]]:
    """`n` labelled texts, written by a seeded rule; half of them within stretches of `hosts`, if there are any."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    num = lambda k: "".join(str(int(x)) for x in rng.integers(0, 10, k))
    name = lambda: pick(NAMES) if rng.random() < 0.3 else "".join(pick("aeioubcdfghlmnprstvwyz") for _ in range(int(rng.integers(2, 10))))

    def word() -> str:
        made = pick(PLAIN) if rng.random() < 0.3 else "".join(pick(["th", "er", "an", "en", "ch", "ou", "re", "st", "ß", "ü", "é", "ó", "ie", "un", "a", "o", "e", "ly", "qu", "on", "in", "ing", "tion", "ent", "or", "ea", "he", "nd", "nt", "ti", "ha", "of", "de", "ó", "ci", "ei", "ver"]) for _ in range(int(rng.integers(1, 5))))
        return made.capitalize() if rng.random() < 0.15 else made

    def card() -> str:
        body = num(int(pick([13, 14, 15, 15, 15, 17])))
        digits = body + next(d for d in "0123456789" if luhn(body + d))
        return pick([" ", "-", ".", "/", "  ", "_", " - "]).join(digits[i : i + 4] for i in range(0, len(digits), 4))

    def email() -> str:
        local = pick([name(), name(), f"{name()}.{name()}", f"{name()}_{name()}", f"{name()}-{name()}", f"{name()}{num(2)}", f"{name()}.{pick('abcdefgh')}", f"{pick('abcdefgh')}.{name()}", f"{name()}.{num(2)}"])
        at = pick(["@", "@", " @ ", " [at] ", "[at]", " (at) ", "(at)", " at ", " at ", " AT ", " {at} ", " [AT] ", "_at_", " <at> "])
        plain = at.strip() == "@" or rng.random() < 0.35 and at.strip() not in ("at", "AT")
        dot = "." if plain else pick([".", " dot ", " dot ", " [dot] ", "[dot]", " (dot) ", "(dot)", " DOT ", " . "] if at.strip() not in ("at", "AT") else [" dot ", " dot ", " DOT ", " [dot] "])
        host = pick([name(), f"{name()}-{name()}", f"mail{num(1)}{dot}{name()}", name()])
        return f"{local}{at}{host}{dot}{pick(['com', 'org', 'net', 'de', 'fr', 'io', 'edu', 'info'])}"

    def phone() -> str:
        spelled = " ".join(pick(NUMBERS) for _ in range(int(rng.integers(7, 12))))
        return pick([
            f"+{num(2)} {num(3)} {num(7)}", f"+1 ({num(3)}) {num(3)}-{num(4)}", f"({num(3)}) {num(3)}-{num(4)}", f"+{num(2)}-{num(3)}-{num(3)}-{num(4)}", f"00{num(2)} {num(3)} {num(7)}", f"00 {num(2)} {num(3)} {num(7)}",
            f"{num(3)}-{num(3)}-{num(4)}", f"{num(3)}.{num(3)}.{num(4)}", f"{num(3)}.{num(3)}.{num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"0{num(3)} / {num(3)} {num(4)}", f"0{num(3)}/{num(7)}", f"{num(3)} {num(3)} {num(4)}", f"0{num(2)} {num(4)} {num(4)}", spelled, spelled,
            f"0{num(3)} {num(8)}", f"0{num(3)} {num(7)}", f"0{num(2)}-{num(7)}", f"0{num(2)}-{num(3)}-{num(4)}", f"({num(5)}) {num(6)}", f"0{num(4)} {num(6)}", f"(0{num(2)}) {num(4)} {num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"0{num(1)} {num(2)} {num(2)} {num(2)} {num(2)}",
        ])

    def ip() -> str:
        return pick([".", " . ", "[.]", " dot ", "(.)", " [dot] ", ". "]).join(str(int(x)) for x in rng.integers(0, 256, 4))

    def stretch() -> tuple[str, list[Span]]:
        """Some words of a host, often from within a line, and the base spans in them, the longest where they overlap."""
        host = pick(hosts)
        at = int(rng.integers(0, max(1, len(host))))
        words = host[at : at + int(rng.integers(20, 160))].split(" ")
        text = " ".join(words[1:-1])
        taken: list[Span] = []
        for a, b, kind in sorted(base_spans(text), key=lambda s: s[0] - s[1]):
            if not any(a < y and x < b for x, y, _ in taken):
                taken.append((a, b, kind))
        return text, sorted(taken)

    makers = {"email": email, "ip": ip, "card": card, "phone": phone}
    none = [
        lambda: f"{num(4)}-{num(2)}-{num(2)}", lambda: f"v{num(1)}.{num(1)}.{num(2)}", lambda: f"{num(2)}:{num(2)}", lambda: "$" + num(3) + "." + num(2), lambda: num(int(rng.integers(1, 20))),
        lambda: hashlib.md5(num(6).encode()).hexdigest()[: int(rng.integers(8, 41))], lambda: f"#{num(5)}", lambda: f"@{name()}", lambda: f"{num(1)}.{num(1)}", lambda: f"sk-{name()}{num(12)}{name()}",
        lambda: f'token = "{hashlib.sha1(num(6).encode()).hexdigest()}"', lambda: f"AKIA{num(6)}{name().upper()}{num(4)}", lambda: f"{num(3)}.{num(3)}", lambda: f"No. {num(3)}", lambda: f"ISBN 978-{num(1)}-{num(2)}-{num(6)}-{num(1)}", lambda: f"{num(5)}-{num(4)}", lambda: f"{num(3)}-{num(2)}-{num(4)}", lambda: num(int(rng.integers(7, 17))), lambda: f"{num(4)}-{num(4)}", lambda: f"{num(2)} {num(3)} {num(3)}", lambda: " ".join(num(2) for _ in range(int(rng.integers(3, 6)))), lambda: " ".join(num(4) for _ in range(int(rng.integers(2, 5)))), lambda: f"{num(1)},{num(3)},{num(3)},{num(3)}", lambda: f"{num(2)}%", lambda: f"{num(1)}, {num(2)}, {num(1)}, {num(2)}",
        lambda: f"at {name()}. {word().capitalize()}", lambda: f"{pick(NUMBERS)} {word()} {pick(NUMBERS)}", lambda: f"{name()} at the dot {name()}", lambda: f"{pick(NUMBERS)} {pick(NUMBERS)} {name()}", lambda: f"look at {name()} and {name()}.",
        lambda: f"{name()}.{name()}", lambda: f"{name()}/{name()}.html", lambda: f"{num(1)},{num(3)},{num(3)}", lambda: f"{num(2)}.{num(2)}.{num(4)}", lambda: f"www.{name()}.com", lambda: f"{name()} dot {name()}", lambda: "#" * int(rng.integers(1, 9)), lambda: f"{num(1)}.{num(1)}.{num(1)}", lambda: f"{name()} [{name()}] {name()}",
        lambda: " ".join([word()] * int(rng.integers(3, 12))), lambda: " ".join([word()] * int(rng.integers(12, 50))), lambda: " ".join(word() + pick(["***", "&&&", "###", "$$$", "%%%", ",", ".***"]) for _ in range(int(rng.integers(2, 6)))), lambda: " ".join(word() for _ in range(int(rng.integers(4, 14)))), lambda: ". ".join(word() for _ in range(int(rng.integers(2, 7)))),
        lambda: pick([" ", " ", " | ", ", ", " - "]).join(word() for _ in range(int(rng.integers(6, 20)))), lambda: " ".join([pick(["de", "at", "at", "dot", "one", "com"]) + pick(["", "", "."])] * int(rng.integers(3, 15))),
    ]
    out = []
    for _ in range(n):
        inside = bool(hosts) and rng.random() < 0.5
        text, spans = stretch() if inside else (" ".join(word() for _ in range(int(rng.integers(0, 5)))), [])
        for _ in range(int(rng.integers(1, 3))):
            text += pick([" ", " ", ", ", ": ", "\n", " or ", " and "]) if text else ""
            if rng.random() < 0.55:
                kind = pick((*KINDS, "email", "phone"))
                body = makers[kind]()
                spans.append((len(text), len(text) + len(body), kind))
            else:
                body = pick(none)()
            text += body + pick([" ", ". ", ", ", " ", "!! ", "\n"])
            after, own = stretch() if inside else (" ".join(word() for _ in range(int(rng.integers(0, 5)))), [])
            spans += [(len(text) + a, len(text) + b, kind) for a, b, kind in own]
            text += after
        out.append((text, spans))
    return out


def untrained() -> Tagger:
    allowed = np.array([[not b.startswith("I") or (a[1:] == b[1:] and a != "O") for b in TAGS] for a in TAGS])
    return Tagger(N_CHARS, len(TAGS), allowed, np.array([not t.startswith("I") for t in TAGS]), hidden=HIDDEN)


@lru_cache(maxsize=1)
def trained() -> Tagger:
    """The tagger with the weights that are kept."""
    tagger = untrained()
    with np.load(WEIGHTS) as kept:
        tagger.p = {name: kept[name] for name in tagger.p}
    return tagger


def fitted(samples: list[tuple[str, list[Span]]], epochs: int = EPOCHS) -> Tagger:
    """A tagger trained on labelled texts."""
    tagger = untrained()
    samples = sorted(samples, key=lambda s: len(s[0]))
    longest = len(samples[-1][0])
    ids, mask, tags = (np.zeros((len(samples), longest), k) for k in (np.int32, np.float32, np.int64))
    for i, (text, spans) in enumerate(samples):
        ids[i, : len(text)], mask[i, : len(text)] = char_ids(text), 1
        for a, b, kind in spans:
            tags[i, a], tags[i, a + 1 : b] = TAGS.index(f"B-{kind}"), TAGS.index(f"I-{kind}")
    for epoch, loss in enumerate(tagger.train(ids, mask, tags, epochs)):
        print(f"epoch {epoch}: loss {loss:.4f}")
    return tagger


def window_spans(tagger: Tagger, ids: list[np.ndarray], window: int = WINDOW, stride: int = STRIDE, batch: int = 768) -> list[list[tuple[int, int, str, float]]]:
    """For each text all spans (start, end, kind, weight) that one of its overlapping windows shows.

    A span weighs its length times the least marginal probability of its tags, half of it if it touches an end of the window that
    isn't one of the text; spans with a tag that isn't CONFIDENT are left out.
    """
    out: list[list] = [[] for _ in ids]
    windows = [(i, s) for i, x in enumerate(ids) for s in range(0, max(1, len(x) - (window - stride)), stride) if len(x)]
    windows.sort(key=lambda w: min(window, len(ids[w[0]]) - w[1]))

    def shown(own: list, sizes: np.ndarray, tags: np.ndarray, sure: np.ndarray) -> None:
        for (i, s), n, row, p in zip(own, sizes.tolist(), tags, sure, strict=True):
            for a in np.flatnonzero(row % 2 == 1).tolist():
                b = a + 1
                while b < n and row[b] == row[a] + 1:
                    b += 1
                least = float(p[a:b].min())
                if least >= CONFIDENT:
                    cut = (a == 0 and s > 0) or (b == n and s + n < len(ids[i]))
                    out[i].append((s + a, s + b, TAGS[row[a]][2:], least * (b - a) * (0.5 if cut else 1.0)))

    def decode(loud: list[tuple[tuple[int, int], np.ndarray]]) -> None:
        sizes = np.array([len(e) for _, e in loud])
        emit, mask = np.zeros((len(loud), sizes.max(), len(TAGS)), np.float32), np.arange(sizes.max()) < sizes[:, None]
        for r, (_, e) in enumerate(loud):
            emit[r, : len(e)] = e
        tags = tagger.viterbi(emit, mask)
        rows = np.flatnonzero(tags.any(1))
        if len(rows):
            tags = tags[rows]
            sure = np.take_along_axis(tagger.marginals(emit[rows].astype(np.float64), mask[rows]), tags[:, :, None], 2)[:, :, 0]
            shown([loud[r][0] for r in rows], sizes[rows], tags, sure)

    waiting: list[tuple[tuple[int, int], np.ndarray]] = []  # windows that may have a span, decoded many at once
    for k in range(0, len(windows), batch):
        own = windows[k : k + batch]
        sizes = np.array([min(window, len(ids[i]) - s) for i, s in own])
        x, mask = np.zeros((len(own), sizes.max()), np.int32), np.arange(sizes.max()) < sizes[:, None]
        for r, (i, s) in enumerate(own):
            x[r, : sizes[r]] = ids[i][s : s + window]
        emit = tagger.scores(x, mask)
        waiting += [(own[r], emit[r, : sizes[r]].copy()) for r in np.flatnonzero(~tagger.quiet(emit)).tolist()]
        if len(waiting) >= batch:
            decode(waiting)
            waiting = []
    if waiting:
        decode(waiting)
    return out


def reconciled(spans: list[tuple[int, int, str, float]]) -> list[Span]:
    """The spans, none overlapping another, that weigh most together; in order."""
    best: dict[Span, float] = {}
    for a, b, kind, weight in spans:
        best[a, b, kind] = max(weight, best.get((a, b, kind), 0.0))
    every = sorted(best, key=lambda s: (s[1], s[0], KINDS.index(s[2])))
    ends, total, took = [s[1] for s in every], [0.0], []
    for i, s in enumerate(every):
        before = bisect.bisect_right(ends, s[0], 0, i)
        took.append(before if total[before] + best[s] > total[i] else None)
        total.append(max(total[i], total[before] + best[s]))
    out, i = [], len(every)
    while i:
        if took[i - 1] is None:
            i -= 1
        else:
            out.append(every[i - 1])
            i = took[i - 1]
    return out[::-1]


AT = re.compile(r"@|(?<![A-Za-z])at(?![A-Za-z])", re.IGNORECASE)
DOT = re.compile(r"\.|(?<![A-Za-z])dot(?![A-Za-z])", re.IGNORECASE)
SAID = re.compile("|".join(NUMBERS), re.IGNORECASE)


def holds(text: str, kind: str) -> bool:
    """Whether a span has what its kind must have, read with number words as digits and "at" and "dot" as their signs.

    An e-mail: a local part, one at sign, a host and after its last dot two letters or more, no more than five words apart from
    signs. An ip: four numbers of up to 255. A card: 14 to 19 digits that pass Luhn. A phone: 7 to 15 digits and no letters.
    """
    if kind == "email":
        parts = AT.split(text)
        host = DOT.split(parts[-1])
        names = [p.strip(" \t\r\n()[]{}<>_") for p in (parts[0], *host)]
        return len(parts) == 2 and len(host) > 1 and all(names) and all(re.fullmatch(r"[\w-]+", x, re.ASCII) for x in names[1:]) and len(names[0].split()) <= 3 and re.fullmatch("[A-Za-z]{2,}", names[-1]) is not None
    said = SAID.sub(lambda m: str(NUMBERS.index(m[0].lower())), text)
    if kind == "ip":
        numbers = re.findall("[0-9]+", said)
        return len(numbers) == 4 and all(len(x) <= 3 and int(x) <= 255 for x in numbers)
    digits = "".join(c for c in said if c in string.digits)
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    return 7 <= len(digits) <= 15 and not any(c.isalpha() for c in said)


def added_spans(tagger: Tagger, texts: list[str], base: list[list[Span]]) -> list[list[Span]]:
    """The tagger's spans of each text that hold and overlap no base span."""
    found = [[s for s in reconciled(spans) if holds(t[s[0] : s[1]], s[2])] for t, spans in zip(texts, window_spans(tagger, [char_ids(t) for t in texts]), strict=True)]
    return [[s for s in spans if not any(s[0] < y and x < s[1] for x, y, _ in own)] for spans, own in zip(found, base, strict=True)]


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def found(docs: DataFrame) -> DataFrame:
    """Personal data in every whole text of `docs` (doc_id, text); one row per row.

    Returned: doc_id, the numbers of base spans n_email, n_ip, n_card, n_phone, base_sha256 (of the base spans as
    kind:start:end, by start, then kind, comma-joined; offsets in code points, ends exclusive), spans (base and added ones,
    written likewise), n_added. A null text counts as empty. Rows that repeat a doc_id are scanned each. Other columns are
    ignored. An empty table gives an empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(trained())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_chunks(batches, 1 << 22):
            texts = batch.column(1).to_pylist()
            base = [base_spans(t) for t in texts]
            rows = []
            for spans, more in zip(base, added_spans(sent.value, texts, base), strict=True):
                every = sorted(spans + more, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))
                counts = [sum(s[2] == k for s in spans) for k in KINDS]
                rows.append((*counts, hashlib.sha256(written(spans).encode()).hexdigest(), written(every), len(more)))
            columns = list(zip(*rows, strict=True)) or [()] * 7
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=[x.split()[0] for x in FOUND.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(scan, FOUND)


def main(documents: str) -> None:
    """Trains on the first HOSTS texts of a Parquet table and writes the weights."""
    import pyarrow.parquet as pq

    hosts = tuple(t for t in pq.read_table(documents, columns=["text"])["text"].to_pylist()[:HOSTS] if t)
    np.savez_compressed(WEIGHTS, **fitted(training(hosts=hosts)).p)


if __name__ == "__main__":
    import sys

    main(sys.argv[1])
