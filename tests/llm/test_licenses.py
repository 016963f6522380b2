import random
import re

import pytest

from lumenlog.llm.license_templates import TEMPLATES
from lumenlog.llm.licenses import compile_templates, license_scan, parse, words_of
from lumenlog.llm.queries import LICENSE_PHRASES, op12_license_scan

SF = "/root/testdata/sf0.01"


def as_regex(parts):
    """The plain version: a pattern over words that are each followed by one blank."""
    out = []
    for p in parts:
        if isinstance(p, bytes):
            out.append(re.escape(p.decode()) + " ")
        elif p[0] == "optional":
            out.append(f"(?:{as_regex(p[1])})?")
        else:
            out.append(f"(?:[^ ]+ ){{{p[1]},{p[2]}}}")
    return "".join(out)


def brute(templates, text):
    """(template, start, end): the longest match at every start, tried one by one."""
    words = [w.decode() for w in words_of(text.encode())]
    out = []
    for t, (_, template) in enumerate(templates):
        parts = parse(template)
        pattern, last = re.compile(as_regex(parts)), 0
        plain = all(isinstance(p, bytes) for p in parts)
        for i in range(len(words)):
            if i < last and not plain:
                continue
            ends = [j for j in range(i + 1, min(len(words), i + 700) + 1)
                    if pattern.fullmatch("".join(w + " " for w in words[i:j]))]
            if ends:
                out.append((t, i, max(ends)))
                last = max(ends)
    return sorted(out, key=lambda p: (p[1], p[0]))


def test_places_against_brute_force():
    rnd = random.Random(4)

    def template(depth=0):
        out = [rnd.choice("abc")]
        for _ in range(rnd.randint(0, 4)):
            kind = rnd.random()
            if kind < 0.25 and depth < 2:
                out.append(f"<<beginOptional>>{template(depth + 1)}<<endOptional>>")
            elif kind < 0.4:
                low = rnd.randint(0, 2)
                out.append(f'<<var;name="x";words="{low}-{low + rnd.randint(0, 2)}">>')
            else:
                out.append(rnd.choice("abc"))
        return " ".join([*out, rnd.choice("abc")])
    for _ in range(400):
        templates = [(f"L{i}", template()) for i in range(3)]
        machine = compile_templates(templates)
        for _ in range(5):
            text = " ".join(rnd.choices("abcd", k=rnd.randint(0, 25)))
            assert machine.places(words_of(text.encode())) == brute(templates, text), (templates, text)


def filled(parts, rnd):
    out = []
    for p in parts:
        if isinstance(p, bytes):
            out.append(p.decode())
        elif p[0] == "optional":
            out += filled(p[1], rnd) if rnd.random() < 0.5 else []
        else:
            out += [rnd.choice(["Ann", "2024", "Société", "X"]) for _ in range(rnd.randint(p[1], p[2]))]
    return out


def test_published_templates_accept_their_variants_and_nothing_else():
    rnd = random.Random(7)
    machine = compile_templates(TEMPLATES)
    for t, (label, template) in enumerate(TEMPLATES):
        parts = parse(template)
        for _ in range(5):
            words = filled(parts, rnd)
            text = "Intro. " + " ".join(w.upper() if rnd.random() < 0.3 else w + rnd.choice(["", ",", "."]) for w in words) + "\nOutro"
            found = machine.places(words_of(text.encode()))
            assert label in {machine.labels[x] for x, _, _ in found}
            must = [i for i, w in enumerate(words) if w.encode() in machine.required[t]]
            broken = list(words)
            broken[rnd.choice(must)] = "zzz"
            again = machine.places(words_of(" ".join(broken).encode()))
            assert all(" ".join(broken[a:b]) != " ".join(words) for x, a, b in again)
    mit = dict(TEMPLATES)["Unlicense"]
    assert machine.places(words_of(mit.replace("free and", "free or").encode())) == []


def test_markup_errors():
    for bad in ('<<var;name="x";words="0-1">> a', 'a <<var;name="x";words="0-1">>', "<<beginOptional>>a", "a<<endOptional>>", "",
                "<<beginOptional>>a<<endOptional>>", 'a <<var;name="x">> b', "a <<what>> b"):
        with pytest.raises(ValueError):
            compile_templates([("L", bad)])


def test_table_with_nulls_repeats_and_clashes(spark):
    long = "word " * 200_000 + "Released under the MIT License"
    rows = [(1, "MIT-License, mit LICENSE", "a"), (1, "MIT-License, mit LICENSE", "b"), (None, "The MIT License", None), (2, None, None), (3, "", None),
            (4, long, None), (5, "mité license", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, _places string")
    got = {(r["doc_id"], r["_n_words"], r["_covered"], tuple((p["label"], p["start"], p["end"]) for p in r["_places"]))
           for r in license_scan(df, [*LICENSE_PHRASES, *TEMPLATES]).collect()}
    twice = (("mit", 0, 2), ("mit", 2, 4))
    assert got == {(1, 4, 4, twice), (None, 3, 2, (("mit", 1, 3),)), (2, 0, 0, ()), (3, 0, 0, ()), (5, 2, 0, ()),
                   (4, 200_005, 5, (("MIT", 200_000, 200_005), ("mit", 200_003, 200_005)))}
    assert license_scan(df.limit(0), LICENSE_PHRASES).collect() == []


def test_query_against_plain_version(spark):
    got = {r["doc_id"]: r.asDict() for r in op12_license_scan(spark, SF).collect()}
    texts = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    patterns = [(label, re.compile(r"(?<![^ ])" + as_regex(parse(t)))) for label, t in TEMPLATES]
    labels = set()
    for r in texts:
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), r["text"] or ""))
        joined = "".join(w + " " for w in words)
        base = [(i, label) for label, phrase in LICENSE_PHRASES for i in range(len(words))
                if words[i:i + len(phrase.split())] == phrase.split()]
        own = {label for label, p in patterns if p.search(joined)}
        labels |= own
        row = got.pop(r["doc_id"])
        score = row.pop("score")
        assert 0 <= score <= 1 and (score > 0) == bool(base or own)
        assert row == {
            "doc_id": r["doc_id"], "n_words": len(words), "n_base": len(base), "first_word": min((i for i, _ in base), default=None),
            "last_word": max((i for i, _ in base), default=None), "base_labels": ",".join(sorted({x for _, x in base})),
            "labels": ",".join(sorted({x for _, x in base} | own))}
    assert not got and {"MIT", "Apache-2.0", "GPL-3.0", "CC-BY-NC-4.0"} <= labels
