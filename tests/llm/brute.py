"""Plain versions of the operators' contracts, and a fixture of awkward documents."""

import hashlib
import re
import zlib

DOC = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", " \n\t", "a", "A b", "a b c d e", "...", "1 2 3", "x" * 5000, "word " * 3000, "\u00e9\u00e8 \u00fc\u00df \u00e9", "\U0001f600 ok", "'s don't 'll", "<|endoftext|> a<|startoftext|>b"]


def documents(spark, small):
    """The smallest documents and awkward ones: nulls, copies, ties, very long texts."""
    real = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()
    rows = [tuple(r) for r in real]
    top = max(r[0] for r in rows) + 1
    longest = max((r[1] for r in rows), key=len)
    texts = ODD + ODD[3:6] + [rows[0][1], rows[1][1] + " more words", longest + " " + longest]
    rows += [(top + k, x, None if k % 3 else "en", None if k % 4 == 0 else f"odd{k % 3}", len(x or "")) for k, x in enumerate(texts)]
    return rows


def frame(spark, rows):
    """With extra columns whose names the operators use inside."""
    df = spark.createDataFrame(rows, DOC).repartition(5)
    return df.selectExpr("*", "'x' AS sig", "1 AS n", "2L AS size", "'y' AS hash", "0.5D AS score", "'z' AS id", "3 AS start", "true AS kept")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def crc(value):
    return zlib.crc32(str(value).encode())


def near_duplicates(rows, size, hundredths=80):
    sets = {}
    for doc, text, *_ in rows:
        w = words(lower(text))
        sets[doc] = {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= hundredths * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((find(a), find(b)))
                    parent[y] = x
    return {d: (d, len(sets[d]), find(d), find(d) == d) for d in ids}


def decontaminate(rows, items, window=13):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = {}
    for item, text in items:
        w = pattern.findall(lower(text))
        for i in range(max(1, len(w) - window + 1)) if w else ():
            windows.setdefault(tuple(w[i : i + window]), set()).add(str(item))
    out = {}
    for doc, text, *_ in rows:
        w = pattern.findall(lower(text))
        hit, found = set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if of := windows.get(tuple(w[i : i + n])):
                    hit |= set(range(i, i + n))
                    found |= of
        out[doc] = (doc, len(w), len(hit), len(found), sha(",".join(sorted(found))), len(hit) > 0 and 20 * len(hit) >= len(w))
    return out


def substring_dedup(rows, window=20):
    seen, out = set(), {}
    for doc, text, *_ in sorted(rows, key=lambda r: r[0]):
        w = words(text)
        gone = set()
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            if key in seen:
                gone |= set(range(i, i + window))
            seen.add(key)
        out[doc] = (doc, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))
    return out
