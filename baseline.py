"""A plain single-process version of the headline rules, for comparison with bench.py; prints one JSON line.

Every rule is the textbook loop over Python lists: one pass that tokenizes the corpus, one loop over
the questions. BENCH_SF_DIR names the data directory.
"""

import json
import math
import os
import re
import time
from collections import Counter, defaultdict

import pyarrow.parquet as pq

from leafline.functions.tokens import STOPWORDS
from leafline.operators.chunking import Packer, tidy

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")


def rows(name: str) -> list[dict]:
    return pq.read_table(f"{SF_DIR}/{name}.parquet").to_pylist()


def tokens(text: str | None) -> list[str]:
    out = []
    for t in re.findall(r"[a-z0-9]+(?:[-'][a-z0-9]+)?", (text or "").lower()):
        out += [t, *filter(None, re.split("[-']", t))]
        if t.endswith("ies") and len(t) > 4:
            out.append(t[:-3] + "y")
        elif t.endswith("s") and not t.endswith("ss") and len(t) > 3:
            out.append(t[:-1])
    for run in re.findall("[一-鿿]+", (text or "").lower()):
        out += [*run, *(run[i : i + 2] for i in range(len(run) - 1))]
    return [t for t in out if t not in STOPWORDS]


def latest(name: str, key: str, at: str, tie: str) -> list[dict]:
    best: dict = {}
    for r in rows(name):
        old = best.get(r[key])
        if old is None or (r[at], r[tie]) > (old[at], old[tie]):
            best[r[key]] = r
    return list(best.values())


def bm25(k: int = 3) -> int:
    chunks, cases = latest("chunks", "chunk_id", "created_at", "chunk_no"), rows("eval_cases")
    postings, lengths, low = defaultdict(list), [], []
    for i, c in enumerate(chunks):
        counts = Counter(tokens(c["text"]))
        lengths.append(sum(counts.values()))
        low.append(" ".join((c["text"] or "").split()).lower())
        for t, n in counts.items():
            postings[t].append((i, n))
    average, n, found = max(sum(lengths) / len(lengths), 1.0), len(chunks), 0
    for q in cases:
        scores: Counter = Counter()
        for t in set(tokens(q["query"])):
            idf = math.log(1 + (n - len(postings[t]) + 0.5) / (len(postings[t]) + 0.5))
            for i, tf in postings[t]:
                scores[i] += idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * lengths[i] / average))
        phrase = " ".join((q["query"] or "").split()).lower()
        if len(phrase) >= 3:
            for i, text in enumerate(low):
                if phrase in text:
                    scores[i] += 1.5
        found += len(sorted(scores.items(), key=lambda x: (-round(x[1], 4), chunks[x[0]]["file_id"], chunks[x[0]]["chunk_index"]))[:k])
    return found


def tfidf(k: int = 3) -> int:
    chunks, cases = latest("chunks", "chunk_id", "created_at", "chunk_no"), rows("eval_cases")
    counted = [Counter(tokens(c["text"])) for c in chunks]
    df = Counter(t for c in counted for t in c)
    idf = {t: math.log((len(chunks) + 1) / (n + 1)) + 1 for t, n in df.items()}
    vectors = [{t: n / sum(c.values()) * idf[t] for t, n in c.items()} for c in counted]
    norms = [math.sqrt(sum(w * w for w in v.values())) for v in vectors]
    by_token = defaultdict(list)
    for i, v in enumerate(vectors):
        for t, w in v.items():
            by_token[t].append((i, w))
    found = 0
    for q in cases:
        own = Counter(tokens(q["query"]))
        weights = {t: n / sum(own.values()) * idf[t] for t, n in own.items() if t in idf}
        dots: Counter = Counter()
        for t, w in weights.items():
            for i, x in by_token[t]:
                dots[i] += w * x
        length = math.sqrt(sum(w * w for w in weights.values()))
        found += len(sorted(((round(d / (norms[i] * length), 6), i) for i, d in dots.items()), reverse=True)[:k])
    return found


def chunk_pack() -> int:
    made, by_file = 0, defaultdict(list)
    for r in latest("extract_page_lines", "line_id", "extracted_at", "line_id"):
        by_file[r["file_id"]].append((r["page_number"], r["line_no"], r["extracted_at"], r["text"] or ""))
    for own in by_file.values():
        newest = {(p, n): t for p, n, _, t in sorted(own)}
        packer = Packer()
        for (page, _), text in sorted(newest.items()):
            unit = tidy(text)
            made += len(list(packer.add(page, unit))) if unit else 0
        made += len(list(packer.close()))
    return made


def dense(k: int = 10) -> int:
    vectors = [(r["vec_id"], r["embedding"]) for r in rows("embeddings")]
    found = 0
    for i, v in vectors:
        if i % 50 == 0:
            found += len(sorted(((-round(sum(map(float.__mul__, v, w)), 12), j) for j, w in vectors if j != i))[:k])
    return found


if __name__ == "__main__":
    times = {}
    for name, f in (("bm25_topk", bm25), ("tfidf_topk", tfidf), ("chunk_pack", chunk_pack), ("dense_topk", dense)):
        began = time.perf_counter()
        f()
        times[name] = round(time.perf_counter() - began, 2)
    print(json.dumps({"metric": "seconds of the plain single-process version", "unit": "sec", "queries": times, "sf": os.path.basename(SF_DIR.rstrip("/"))}))
