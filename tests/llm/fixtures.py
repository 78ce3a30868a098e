"""Documents and brute-force versions for the tests of this folder."""

import hashlib
import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOC_SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    "score string, kept string, size string, node string, row string, words string, text_ string, key_id string, copies string"
)
BIG_ID = (1 << 60) + 1


def prose(seed, n, words=60):
    draw = random.Random(seed)
    pool = ["".join(draw.choice("abcdefghijklmno") for _ in range(draw.randint(2, 8))) for _ in range(words)]
    return " ".join(draw.choice(pool) for _ in range(n))


def odd_documents():
    """Nulls in every column, empty and blank texts, one very long text, repeated rows, ties, large ids."""
    base = prose(1, 120, 400)
    long = prose(2, 60_000, 9_000)
    cases = [
        (1, None, "en", "a"),
        (2, "", "en", "a"),
        (3, " \n\t\r\x0b\x0c ", None, "a"),
        (4, "word", "en", None),
        (5, base, "en", "a"),
        (5, base, "en", "a"),
        (6, base, "de", "b"),
        (7, base.upper(), "de", "b"),
        (8, base.replace(" ", "\n", 20), None, None),
        (None, base + " tail", "en", "b"),
        (None, "lost words", "en", "b"),
        (None, None, None, None),
        (BIG_ID, long, "en", "c"),
        (BIG_ID + 1, long + " more", "en", "c"),
        (9, "x" * 300_000, "en", "c"),
        (10, "1" * 100_000 + " a@b.co " + "é ß 漢字 😀 " * 50, "fr", "c"),
        (10, "other text under the same id", "fr", "c"),
        (11, "line\n" * 50, "fr", "d"),
    ]
    return [(i, t, lang, s, None if t is None else len(t), *["x"] * 9) for i, t, lang, s in cases]


def words_of(text):
    return WORD.findall(text or "")


def shingle_set(text, width):
    words = words_of("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return frozenset()
    width = min(width, len(words))
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1))


def components_of(docs, width):
    """Smallest id reachable over links of similarity 0.8, by comparing all pairs. docs: (id, text)."""
    sets = [(i, shingle_set(t, width)) for i, t in docs]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for at, (i, a) in enumerate(sets):
        for j, b in sets[:at]:
            both = len(a & b)
            if a and b and 100 * both >= 80 * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: find(i) for i, _ in sets}


def repeat_words(text):
    words = words_of(text)
    at = {}
    for i in range(len(words) - 7):
        at.setdefault(tuple(words[i : i + 8]), []).append(i)
    return len({p + k for places in at.values() if len(places) > 1 for p in places for k in range(8)})


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def luhn(digits):
    doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(sum(map(int, str(d))) for d in doubled) % 10 == 0


KINDS = ("email", "ip", "card", "phone")


def plain_spans(text):
    """The base spans by plain patterns: (start, end, kind)."""
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub(r"\D", "", m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub(r"\D", "", m[0])) <= 15:
            found.append((m.start(), 3, m.end()))
    return [(s, e, KINDS[k]) for s, k, e in sorted(found)]


# The shapes of identifier-like words and the punctuation around them.
SHAPES = {
    "email": r"[^@]+@[^@]+",
    "ip": r"[0-9]+(?:[.:][0-9]+){3,}|[0-9A-Fa-f]*(?::[0-9A-Fa-f]*){3,}",
    "card": r"(?:[0-9]-?){12,19}",
    "phone": r"[+(]?[0-9](?:[().-]?[0-9]){6,14}",
}
EDGES = ".,;:!?()[]{}<>\"'|*"


def plain_mentions(text):
    """(start, end, kinds, is seed, patterns) of seeds and identifier-like words, in order."""
    base = plain_spans(text)
    found = [(s, e, [k], True) for s, e, k in base]
    for m in WORD.finditer(text):
        if not re.search("[@0-9]", m[0]):
            continue
        start = m.end() - len(m[0].lstrip(EDGES))
        word = m[0].strip(EDGES)
        end = start + len(word)
        kinds = [k for k, shape in SHAPES.items() if re.fullmatch(shape, word)]
        if word and kinds and not any(s < end and e > start for s, e, _ in base):
            found.append((start, end, kinds, False))
    out, before = [], 0
    for start, end, kinds, seed in sorted(found):
        head = text[:start]
        words = re.findall(rf"[^\s{re.escape(EDGES)}]+", head)
        if words and before <= len(head.rstrip(EDGES + " \n\t\r\x0b\x0c")):
            last = len(head.rstrip(EDGES + " \n\t\r\x0b\x0c"))
            words[-1] = words[-1][max(0, before - (last - len(words[-1]))) :]
            words = [w for w in words if w]
        words = [w.lower() for w in words[-2:]]
        out.append((start, end, kinds, seed, [" ".join(words[-n:]) for n in (1, 2) if len(words) >= n]))
        before = max(before, end)
    return out


def plain_patterns(texts, least=5, rounds=3, confidence=0.8):
    """Patterns (pattern, kind) of high score, by the definition of the graph, in dictionaries."""
    seeds, edges = set(), set()
    for text in texts:
        for start, end, kinds, seed, patterns in plain_mentions(text or ""):
            for kind in kinds:
                instance = (kind, text[start:end].lower())
                edges |= {((p, kind), instance) for p in patterns}
                if seed:
                    seeds |= {((p, kind), instance) for p in patterns}
    support = {}
    for pattern, _ in seeds:
        support[pattern] = support.get(pattern, 0) + 1
    edges = {(p, i) for p, i in edges if support.get(p, 0) >= least}
    worth = {}
    for p, i in edges:
        worth[i] = max(worth.get(i, 0.0), float((p, i) in seeds))
    sure = {i for _, i in seeds & edges}
    of_pattern, of_instance = {}, {}
    for p, i in edges:
        of_pattern.setdefault(p, []).append(i)
        of_instance.setdefault(i, []).append(p)
    # The first scores take a pair that is a seed in one context and none in another as two instances of it.
    score = {}
    for turn in range(rounds):
        for p, own in of_pattern.items():
            if turn == 0:
                values = []
                for i in own:
                    flags = {float((q, i) in seeds) for q in of_instance[i]}
                    values += sorted(flags)
            else:
                values = [worth[i] for i in own]
            score[p] = round(sum(values) / len(values), 6)
        for i, own in of_instance.items():
            doubt = 1.0
            for p in own:
                doubt *= max(1 - score[p], 1e-9)
            worth[i] = 1.0 if i in sure else round(1 - doubt, 6)
    return {p for p, s in score.items() if s >= confidence}


def plain_all_spans(text, patterns):
    more = []
    for start, end, kinds, seed, around in plain_mentions(text):
        kind = next((k for k in kinds if any((p, k) in patterns for p in around)), None)
        if kind and not seed:
            more.append((start, end, kind))
    return sorted(plain_spans(text) + more, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def plain_masked(text, spans):
    """Overlapping spans become one mark, named after the first."""
    out, done = "", 0
    for start, end, kind in spans:
        if start >= done:
            out += text[done:start] + f"[{kind.upper()}]"
        done = max(done, end)
    return out + text[done:]
