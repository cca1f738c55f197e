"""What a worker process holds doesn't grow with the rows that pass through it."""

import subprocess
import sys
from pathlib import Path

SCRIPT = """
import sys
import numpy as np, public_tokenizers as P, pyarrow.parquet as pq
from pagewright.llm import codec, common, crf, langid, neardup, tokcount, toxicity, words

rows = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text", "lang"]).to_pylist()
rng = np.random.default_rng(1)
tox = toxicity.fit([(int(i % 9 == 0), words.words_of(r["text"]) + ["vexo"] * (i % 9 == 0)) for i, r in enumerate(rows[:200])])
lang = langid.fit([(r["lang"] or "en", words.words_of(r["text"])) for r in rows[:200] if r["text"]])
resident = lambda: int(open("/proc/self/statm").read().split()[1]) * 4 // 1024


def fresh(k):
    # other words in every turn, and one long text without white space
    mark = "".join(chr(97 + int(c)) for c in str(k * 7919 + 13))
    return [" ".join(w + mark for w in (r["text"] or "").split()[:400]) for r in rows] + ["abc" * 300_000 + mark]


def turn(k):
    texts = fresh(k)
    toxicity.score_texts(common.hold("tox", lambda: crf.WordTable(tox, words.word_of)), texts)
    langid.label_texts(common.hold("lang", lambda: crf.WordTable(lang, words.word_of)), texts)
    for t in texts:
        neardup.signature(neardup.shingles(t))
    own = common.hold("codec", lambda: codec.Codec(P.path(codec.FILE)))
    for t in texts:
        own.encode_bytes(t)
    own = common.hold("counter", lambda: tokcount.Counter(P.path(tokcount.MODEL)))
    for t in texts:
        own.count(t)
    common.hold("none", dict)
    common.freed()


for k in range(7):
    turn(k)
    if k in (2, 6):
        print(resident())
"""


def test_a_workers_memory_stays():
    root = Path(__file__).resolve().parents[2]
    done = subprocess.run([sys.executable, "-c", SCRIPT], cwd=root, capture_output=True, text=True, timeout=600, check=True)
    early, late = map(int, done.stdout.split())
    assert late < early + 60, (early, late)
