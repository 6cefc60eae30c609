"""The native operators against plain Python."""

import re
import textwrap
from collections import Counter

from chunkframe.llm import licence_scan, quality_rules
from chunkframe.llm.licence_scan import TEMPLATES, template_bigrams, template_words


def plain_licence(text, threshold=0.8):
    """Best (template, dice) over all windows between two bigrams of the template, and how
    many templates match."""
    w = re.sub("[^a-z0-9]+", " ", (text or "").lower()).split()
    grams = [f"{a} {b}" for a, b in zip(w, w[1:])]
    found = []
    for k, (name, t) in enumerate(TEMPLATES.items()):
        own, reach = set(template_bigrams(t)), len(template_words(t)) - 1
        best = 0.0
        for i in range(len(grams)):
            if grams[i] in own:
                last = max(j for j in range(i, min(i + reach, len(grams))) if grams[j] in own)
                window = set(grams[i : last + 1])
                best = max(best, 2 * len(own & window) / (len(own) + len(window)))
        if best >= threshold:
            found.append((best, len(own), -k, name))
    return (max(found)[3], max(found)[0], len(found)) if found else (None, 0.0, 0)


def test_licence_dice(spark):
    mit, gpl, isc = (TEMPLATES[k] for k in ("MIT-text", "GPL-3.0-header", "ISC-text"))
    code = "\n".join(f"def f{i}(a, b): return a + b * {i}  # add and scale" for i in range(60))
    wrapped = lambda t, mark="": "\n".join(mark + x for x in textwrap.wrap(t, 72))
    texts = [
        "some prose\nLicensed under the Apache License, Version 2.0.\nmore prose", "released under THE mit license", "Released under the MIT License today.", "Licensed under CC BY 4.0", "Licensed under CC BY-NC 4.0!",
        mit.replace(". ", ".\n").replace(", ", ",\n"), mit + " " + " ".join(f"extra{i}" for i in range(200)), "license", "", None, "no licence at all " * 50, "Licensed under the Apache License, Version 2.0.\n" * 3,
        wrapped(mit, "// ") + "\n" + code, wrapped(gpl, " * ") + "\n" + code, code + "\n" + wrapped(isc, "# ") + "\n" + code, "as said, the text is Licensed under CC BY 4.0. and so on", gpl[:200], " ".join(mit.split()[::2]), "software permission " * 400,
    ] + [t for t in TEMPLATES.values()]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r["doc_id"]: (r["licence"], r["dice"], r["n_matches"]) for r in licence_scan.scan(df).collect()}
    for i, t in enumerate(texts):
        name, dice, n = plain_licence(t)
        assert got[i][0] == name and abs(got[i][1] - dice) < 1e-12 and got[i][2] == n, (t, got[i], name, dice, n)
    assert [got[i][0] for i in (5, 6, 12, 13, 14, 15, 16, 17)] == ["MIT-text", "MIT-text", "MIT-text", "GPL-3.0-header", "ISC-text", "CC-BY-4.0", None, None]
    assert [got[19 + k][0] for k in range(len(TEMPLATES))] == list(TEMPLATES)


def test_hints_lose_no_window():
    """A template with all bigrams removed that hold a hint is short of the threshold."""
    known = {k: template_bigrams(v) for k, v in TEMPLATES.items()}
    chosen = set(licence_scan.hints(known, 0.8))
    for own in known.values():
        assert sum(not chosen & {*g.split()} for g in own) < licence_scan.least_shared(len(own), 0.8)


def plain_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if seen[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def test_rule_counts(edge, spark):
    more = ["a b c d e f g h a b c d e f g h i", "x " * 7, "x " * 8, "x " * 9, "x " * 40, " ".join(map(str, range(30))) + "\n" + " ".join(map(str, range(10))) + "\n \n \nq\nq\n q\n", "#*$%&|<> é b c\x85d\x1ce", "a\r\nb\r\na\r\n" * 20]
    df = spark.createDataFrame([(100 + i, t, "en", "s") for i, t in enumerate(more)], "doc_id bigint, text string, lang string, source string").unionByName(edge.select("doc_id", "text", "lang", "source"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    got = [(r["text"], tuple(r["q"][n] for n in names), r["q"]["kept"]) for r in quality_rules.judge(df, output="q").collect()]
    assert len(got) == df.count()
    for text, counts, kept in got:
        assert counts == plain_counts(text), (text or "")[:80]
        assert not (counts[5] and kept)


def test_a_verdict_depends_on_the_text_alone(spark, sf):
    junk = "BUY!! NOW!! $$$ *** CHEAP!! ### WIN!! %%% " * 3 + " ".join(f"Q{i}!! Z{i}$$" for i in range(60))
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    alone = spark.createDataFrame([(-1, junk, "en")], "doc_id bigint, text string, lang string")
    pick = lambda df: {r["doc_id"]: (r["quality"]["kept"], r["quality"]["class_distance"]) for r in quality_rules.judge(df).collect()}
    one, every = pick(alone), pick(docs.unionByName(alone))
    assert one[-1] == every[-1] and not one[-1][0]
    assert pick(docs.limit(20)).items() <= every.items()
