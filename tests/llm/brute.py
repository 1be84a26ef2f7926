"""Plain, slow versions of the operators, for small inputs."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def quality_base(text):
    w = words(text)
    grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    seen = Counter(grams)
    marked = set()
    for i, g in enumerate(grams):
        if seen[g] > 1:
            marked |= set(range(i, i + 8))
    dup, lines = 0, set()
    for line in (text or "").split("\n"):
        if words(line):
            dup += line in lines
            lines.add(line)
    n = len(w)
    return {
        "n_words": n,
        "word_chars": sum(map(len, w)),
        "n_symbols": len(re.findall(r"[#*$%&|<>]", text or "")),
        "n_dup_lines": dup,
        "n_repeat_words": len(marked),
        "base_failed": n < 20 or 100 * len(marked) > 30 * n,
    }


def fertility(text, lang, model, encoding, languages, scripts, floor):
    """Token figures of one text word by word, and whether its band admits them; ``floor`` maps log2 of tokens to bits."""
    w = words(text)
    ids = [i for x in w for i in model.encode(x)]
    other = sum(len(encoding.encode_ordinary(" " + x)) for x in w)
    n, chars = len(ids), sum(map(len, w))
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(ids).values()) if n else 0.0
    figures = {"n_tokens": n, "chars_per_token": chars / n if n else 0.0, "chars_per_byte_token": chars / other if other else 0.0, "byte_share": sum(map(model.is_byte, ids)) / n if n else 0.0, "token_entropy": entropy}
    latin = sum(c.isascii() and c.isalpha() or "\u00c0" <= c < "\u0280" for c in text or "")
    foreign = sum(c >= "\u0340" for c in text or "")
    band = languages.get(lang) or scripts["latin" if latin >= foreign else "other"]
    (x0, y0), (x1, y1) = next(((a, b) for a, b in zip(floor, floor[1:], strict=False) if a[0] <= math.log2(max(n, 1)) <= b[0]), (floor[-1], (99, floor[-1][1])))
    least = band.floor_shift + y0 + (y1 - y0) * (math.log2(max(n, 1)) - x0) / (x1 - x0)
    inside = [r.least - r.spread / math.sqrt(len(w) or 1) <= figures[k] <= r.most + r.spread / math.sqrt(len(w) or 1) for k, r in (("chars_per_token", band.subword), ("chars_per_byte_token", band.byte_level))]
    return figures, all(inside) and figures["byte_share"] <= band.max_byte_share and least <= entropy <= band.max_entropy


def simhash(text):
    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def simhash_classes(rows):
    """rows: (doc_id, text)."""
    fp = [(i, simhash(t)) for i, t in rows]
    root = {i: i for i, _ in fp}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(fp):
        for j, b in fp[:k]:
            if (a ^ b).bit_count() <= 3:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: (f"{f:016x}", find(i)) for i, f in fp}


def substring(rows, size=13):
    """rows: (doc_id, text); doc_id -> n_words, n_removed, sha256."""
    first = {}
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - size + 1):
            g = tuple(w[k : k + size])
            first[g] = min(first.get(g, i), i)
    out = {}
    for i, t in rows:
        w = words(t)
        gone = set()
        for k in range(len(w) - size + 1):
            if first[tuple(w[k : k + size])] < i:
                gone |= set(range(k, k + size))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def shard_sizes_ok(rows, n_docs, texts, n_shards=16):
    """rows: dicts of the sharding query; raises where a law is broken."""
    assert len(rows) == n_docs
    slots = defaultdict(list)
    for r in rows:
        text = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(text) + 1, zlib.crc32(text))
        assert r["law"] == "rows" and r["grown_shard"] is None and 0 <= r["shard"] < n_shards
        slots[r["shard"]].append(r["slot"])
    sizes = [len(slots[k]) for k in range(n_shards)]
    assert max(sizes) - min(sizes) <= 1
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))


def url_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def url_rule(host, path, rules):
    fit = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fit, key=lambda r: len(r.rule)) if fit else None


def edit_distance(a, b):
    """Least distance of a to any part of b."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        old, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return min(row)
