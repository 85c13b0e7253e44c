"""The corpus operators in plain Python, for small tables."""

import collections
import hashlib
import re

import xxhash

LOW = {c: c + 32 for c in range(65, 91)}
WORD = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, size int, split int, anchors int, mix int, component int"
WORDS = "the of and to in is on by it or be at as an we he so no if up do go me my us am".split()


def sentence(seed, n):
    """``n`` words that look random and depend on the seed alone."""
    state, out = seed * 2654435761 % 2**32 or 1, []
    for _ in range(n):
        state = (1103515245 * state + 12345) % 2**31
        out.append(WORDS[state % 26] + WORDS[state // 64 % 26] + WORDS[state // 4096 % 26])
    return " ".join(out)


def edge_rows():
    """(doc_id, text): nulls, empty, blank, one word, copies in other cases, near copies,
    shared passages, a long text, a long word, other scripts, rows that repeat."""
    base, passage = sentence(1, 120), sentence(2, 30)
    near = base.split()
    near[60] = "changed"
    far = base.split()
    for k in range(5, 120, 9):
        far[k] = f"other{k}"
    return [
        (1, base), (2, base.upper()), (3, base), (4, " ".join(near)), (5, " ".join(far)), (6, None), (7, ""),
        (8, " \t\n "), (9, "word"), (10, "word"), (11, "Word"), (12, "a b c"), (13, sentence(3, 40) + " " + passage),
        (14, passage + "\n" + sentence(4, 40)), (15, sentence(5, 20) + "\n" + passage + "\n" + passage),
        (16, sentence(6, 5000)), (17, "x" * 5000), (18, "12345 67890 !!!"), (19, "été à l'école ÉTÉ, İstanbul ß"),
        (20, "日本語のテキスト 日本語のテキスト"), (21, sentence(1, 120) + "."), (22, sentence(7, 80)),
        (23, "x" * 4999), (24, None), (40, "idiot " * 300), (30, "idiot " * 200), (-5, passage), (2**62, "far away"),
    ]


def frame(spark, rows, **more):
    """The rows as a table of documents with columns whose names operators use inside."""
    full = [
        (i, t, more.get("lang", "xx"), f"src{(i or 0) % 3}", None, "yes", 1, 2, 3, 4, 5) for i, t in rows
    ]
    return spark.createDataFrame(full, SCHEMA)


def odd_rows():
    """Rows without an id and rows that repeat an id."""
    base = sentence(1, 120)
    return [(None, base), (None, None), (None, sentence(8, 50)), (1, base), (1, base), (1, sentence(9, 60)), (2, base)]


def words_of(text):
    return WORD.findall((text or "").translate(LOW))


def near(rows, words, percent=80):
    """[(doc_id, n_shingles, component_id, kept)] by comparing every pair."""
    sets = {}
    for i, text in rows:
        w = words_of(text)
        sets[i] = {tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return sorted((i, len(sets[i]), find(i), find(i) == i) for i in sets)


def near_survivors(rows, words, percent=80):
    """Which rows stay: of each group the smallest id (none comes last), and all without words."""
    found = near([(k, t) for k, (_, t) in enumerate(rows)], words, percent)
    groups = collections.defaultdict(list)
    for k, size, group, _ in found:
        groups[(group, 0) if size else (k, 1)].append(k)
    return sorted(min(ks, key=lambda k: (rows[k][0] is None, rows[k][0] or 0)) for ks in groups.values())


def repeats(rows, least=50):
    """[(doc_id, n_bytes, n_removed, n_spans, kept_sha256)]."""
    first, out = {}, []
    rows = sorted(rows, key=lambda r: r[0])
    raws = [(i, (t or "").encode()) for i, t in rows]
    for i, raw in raws:
        for x in range(len(raw) - least + 1):
            first.setdefault(raw[x : x + least], i)
    for i, raw in raws:
        gone = bytearray(len(raw))
        for x in range(len(raw) - least + 1):
            if first[raw[x : x + least]] < i:
                gone[x : x + least] = b"\1" * least
        kept = bytes(c for c, g in zip(raw, gone) if not g)
        spans = sum(1 for x in range(len(raw)) if gone[x] and (x == 0 or not gone[x - 1]))
        out.append((i, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def _hash(*values):
    seed = 42
    for v in values:
        data = v.encode() if isinstance(v, str) else (v % 2**64).to_bytes(8, "little")
        seed = xxhash.xxh64(data, seed).intdigest()
    return seed - 2**64 if seed >= 2**63 else seed


def syncmers(text, k=7, s=2):
    """[(pos, 32-bit hash)] by looking at each k-mer alone."""
    tokens = re.findall(r"[぀-ヿ一-鿿]|[^\s぀-ヿ一-鿿]{1,24}", text.lower())
    if not tokens:
        return []
    if len(tokens) < k:
        return [(0, (_hash(" ".join(tokens)) % 2**64) >> 32)]
    h = [_hash(t) for t in tokens]
    out = []
    for at in range(len(tokens) - k + 1):
        inner = [_hash(h[at + j], h[at + j + 1]) for j in range(k - s + 1)]
        if min(inner) in (inner[0], inner[-1]):
            mer = _hash(_hash(inner[0], inner[2]), _hash(inner[4], h[at + 6]))
            out.append((at, (mer % 2**64) >> 32))
    return out


def in_order(a, b):
    """Of the anchors in both lists, in the order of the first, the share of all that the
    second has after the one before."""
    x, y = list(dict.fromkeys(a)), list(dict.fromkeys(b))
    places = [y.index(h) for h in x if h in y]
    good = sum(1 for k, p in enumerate(places) if k == 0 or p > places[k - 1])
    union = len({*x, *y})
    return good / union if union else 1.0


def exact(rows):
    groups = collections.defaultdict(list)
    for i, text in rows:
        groups[(text or "").translate(LOW)].append(i)
    return sorted(
        (i, max(ids), len(ids), i == max(ids), hashlib.sha256(text.encode()).hexdigest())
        for text, ids in groups.items()
        for i in ids
    )
