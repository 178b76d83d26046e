"""Small documents with every odd case, and plain versions of what the operators compute."""

import collections
import random
import re
import zlib

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, score double, component_id long, _row string"
SYLLABLES = {"en": ["the", "ing", "tion", "wh", "ou", "er", "th"], "de": ["ung", "sch", "der", "keit", "ü", "ich", "pf"]}


def prose(rng, n, lang="en"):
    out = []
    for i in range(n):
        w = "".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4)))
        out.append(w.capitalize() + "" if i % 9 == 0 else w + ("." if i % 9 == 8 else ""))
    return " ".join(out)


def documents():
    """Rows of SCHEMA: clean prose, near and exact copies, junk, a passage, and odd cases; the extra columns clash with outputs."""
    rng = random.Random(5)
    texts = [(prose(rng, rng.randint(60, 160), lang), lang) for lang in ("en", "de") for _ in range(25)]
    base = texts[0][0].split(" ")
    for k in range(8):  # near copies, each at another place
        w = list(base)
        w[10 + 5 * k] = f"changed{k}"
        texts.append((" ".join(w), "en"))
    texts += [(texts[1][0], "en")] * 5
    texts.append((texts[1][0].upper(), "en"))
    texts += [(" ".join(w + "***" for w in prose(rng, 90).split()), "en") for _ in range(4)]
    texts += [(" ".join(w.upper() + "!!" for w in prose(rng, 90).split()), "en") for _ in range(4)]
    texts += [("Spam spam " * 60 + "end", "en"), ("line one\n" * 40, "en")]
    texts += [(None, "en"), ("", "de"), (" \t\n\x0b\x0c\r ", None), ("12 34 !!", None), ("one", "en"), ("Two words", "en"), ("x" * 5000, None), ("日本 語\u00a0text e\u0301 İ <|endoftext|> 'll", None)]
    texts += [("long " + prose(rng, 6000), "en"), (" ".join(["same"] * 3000), "en")]
    rows = [(i, t, lang, None if i % 11 == 3 else f"src{i % 3 and 1}", len(t or ""), 7, -1.0, 99, "clash") for i, (t, lang) in enumerate(texts)]
    return [*rows, rows[2], (None, texts[3][0], "en", "src1", 1, 7, -1.0, 99, None)]


def words(text):
    return WORD.findall(text or "")


def shingles(text):
    w = words((text or "").translate(LOWER))
    return [tuple(w[i : i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)] if w else []


def fold(doc_id, k):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % k


def base_counts(text):
    w = words(text)
    n, seen, covered = len(w), collections.Counter(zip(w, w[1:], w[2:])), set()  # noqa: B905
    for i in range(n - 2):
        if seen[w[i], w[i + 1], w[i + 2]] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def components(rows):
    """doc_id -> smallest doc_id reachable over links of similarity 0.75."""
    sets = [(r[0], set(shingles(r[1]))) for r in rows if r[0] is not None]
    up = {i: i for i, _ in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, (a, s) in enumerate(sets):
        for b, t in sets[:k]:
            if s and t and 100 * len(s & t) >= 75 * len(s | t):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: root(i) for i in up}


def merges(word, ranks):
    """Byte pairs merged one at a time, the leftmost of least rank first."""
    p = [ranks[word]] if word in ranks else None
    parts = [] if p else [word[i : i + 1] for i in range(len(word))]
    while pairs := [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]:  # noqa: B905
        i = min(pairs)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return p or [ranks[x] for x in parts]
