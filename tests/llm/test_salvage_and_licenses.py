"""Bytes that salvage reads, one rule for damaged members, and the license scan against full alignments of all templates."""

import hashlib
import io
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import license_scan, warc


class Counted(io.BytesIO):
    total = 0

    def read(self, n=-1):
        out = super().read(n)
        self.total += len(out)
        return out


@pytest.mark.parametrize("mb", [2, 8, 32])
def test_salvage_reads_at_most_three_times(mb):
    body = random.Random(1).randbytes(2300)
    one = warc.gzip_member(warc.record_bytes(1, "u", body, hashlib.sha256(body).hexdigest(), None))
    hurt = bytearray(one)
    hurt[len(hurt) // 2] ^= 0xFF
    data = (one + bytes(hurt)) * ((mb << 20) // (2 * len(one)))
    file = Counted(data)
    found = list(warc.salvage(file, len(data)))
    assert sum(isinstance(x, warc.Record) for x in found) == len(data) // (2 * len(one)) and file.total <= 3 * len(data)


def test_damaged_members_follow_one_rule():
    """A member that lost its last bytes gives its record, marked, whatever comes after it."""
    body = random.Random(2).randbytes(900)
    one = warc.gzip_member(warc.record_bytes(1, "u", body, hashlib.sha256(body).hexdigest(), None))
    for k in range(120):
        data = one[:-9] + random.Random(k).randbytes(k % 40) + one
        records = [x for x in warc.salvage(io.BytesIO(data), len(data)) if isinstance(x, warc.Record)]
        assert [x.payload for x in records] == [body, body], k
        assert records[1].unchecked is None
    torn = bytearray(one)
    torn[-6] ^= 0xFF
    (record,) = [x for x in warc.salvage(io.BytesIO(bytes(torn)), len(torn)) if isinstance(x, warc.Record)]
    assert "damaged member" in record.unchecked


# licenses

def full_alignment(doc, template, start, stop):
    """(score, matches, first word, end word) over all cells, by the stated rule."""
    above, best = [(0, 0, 0)] * (len(template) + 1), (0, 0, 0, 0)
    for i in range(start, stop):
        row = [(0, 0, 0)]
        for j, word in enumerate(template):
            a = above[j]
            same = doc[i] == word
            cell = (a[0] + 1, a[1] + 1, a[2] if a[0] else i) if same else (a[0] - 1, a[1], a[2])
            for b in (above[j + 1], row[j]):
                cell = max(cell, (b[0] - 1, b[1], b[2]))
            row.append(cell if cell[0] > 0 else (0, 0, 0))
            if row[-1] > best[:3]:
                best = (*row[-1], i + 1)
        above = row
    return best


def brute_scan(doc, index, percent):
    out = []
    for t, template in enumerate(index.words):
        template, parts, found = template.tolist(), [(0, len(doc))], []
        while parts:
            start, stop = parts.pop()
            score, matches, begin, end = full_alignment(doc, template, start, stop)
            if score and 100 * matches >= percent * len(template):
                found.append((t, matches, begin, end))
                parts += [(start, begin), (end, stop)]
        out += found
    return sorted(license_scan.best_of_kind(out, index), key=lambda x: (x[2], x[0]))


def mixtures(rng, templates):
    words = [f"z{i}" for i in range(300)]
    for _ in range(60):
        text = []
        for _ in range(rng.randint(0, 3)):
            text += [rng.choice(words) for _ in range(rng.randint(0, 40))]
            copy = rng.choice(list(templates.values())).split()
            for _ in range(rng.randint(0, max(1, len(copy) // 6))):
                at = rng.randrange(len(copy))
                copy[at : at + 1] = rng.choice([[], [rng.choice(words)], [copy[at], rng.choice(words)]])
            text += copy
        yield " ".join(text + [rng.choice(words) for _ in range(rng.randint(0, 20))])


def test_scan_equals_full_alignment(spark):
    """Whole scans of random mixtures report what full alignments of every template against every text report."""
    rng = random.Random(3)
    templates = {f"t{k}-{'name' if k < 3 else 'grant'}": " ".join(f"w{rng.randrange(400)}" for _ in range(n)) for k, n in enumerate((5, 9, 16, 40, 80))}
    templates["t9-text"] = " ".join(f"v{i}" for i in range(130))
    index = license_scan.Index(templates)
    texts = list(mixtures(rng, templates))
    docs = [(i, x) for i, x in enumerate(texts)] + [(i, x) for i, x in enumerate(texts[:10])] + [(900, None), (901, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit("own") for c in ("template", "_text", "coverage", "a.b")})
    got = {}
    for r in license_scan.scan(df, templates).collect():
        got.setdefault(r["doc_id"], []).append((index.names.index(r["template"]), r["matched_words"], r["first_word"], r["end_word"]))
    for i, text in enumerate(texts):
        want = brute_scan(license_scan.word_hashes(text).tolist(), index, license_scan.PERCENT)
        assert sorted(got.get(i, [])) == sorted(want * (2 if i < 10 else 1)), text
    assert len(got) > 40 and 900 not in got and license_scan.scan(df.limit(0), templates).count() == 0


def test_alignment_equals_full_alignment():
    rng = random.Random(4)
    for _ in range(150):
        t = [rng.randrange(25) for _ in range(rng.randint(4, 40))]
        d = [rng.randrange(25) for _ in range(rng.randint(0, 9))] + [x for x in t if rng.random() > 0.12] + [rng.randrange(25) for _ in range(5)]
        matches, begin, end = license_scan.align(np.array(d), np.array(t), -len(t), len(d))
        assert (matches, begin, end) == full_alignment(d, t, 0, len(d))[1:]


def test_scan_of_a_very_long_text(spark):
    noise = " ".join(f"q{i % 7919}" for i in range(120_000))
    grant = license_scan.TEMPLATES["mit-grant"]
    (row,) = license_scan.scan(spark.createDataFrame([(1, f"{noise}\n{grant}\n{noise}")], "doc_id long, text string")).collect()
    assert (row["template"], row["coverage"], row["first_word"]) == ("mit-grant", 1.0, 120_000)
