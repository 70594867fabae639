"""License labels of whole, edited and partial notices, and chains against brute force."""

import random
import time

import pytest

from scanloom.llm import licenses

NOT = ["this survey covers including without limitation the rights to water", "you may not use this file except on weekdays", "with or without fee is hereby granted", "this program is free software", "licensed under an agreement of 2004", "all rights reserved"]


def _labels(spark, texts):
    rows = licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()
    return {r["doc_id"]: r for r in rows}


def test_labels_follow_the_share_of_a_passage(spark):
    r = random.Random(1)
    filler = "the river ran past old mills and towns where people worked in small shops every day".split()
    texts, want, kept = [], [], []
    for label, parts in licenses.TEMPLATES.items():
        for part in parts:
            words = part.split()
            for share in (1.0, 0.85, 0.3):
                if share < 1 and len(words) < 20:
                    continue
                said = words if share == 1 else words[: int(share * len(words))]
                if share == 0.85 and len(words) > 40:
                    said = [w for k, w in enumerate(words) if k % 25 != 24]  # single words lost here and there
                texts.append(" ".join([*r.choices(filler, k=9), *said, *r.choices(filler, k=12)]))
                base = {v for k, v in licenses.PHRASES.items() if k in " ".join(licenses.template_words(texts[-1]))}
                want.append(base | ({label} if share > 0.5 else set()))
                kept.append(share)
    found = _labels(spark, texts + NOT)
    for k, labels in enumerate(want):
        assert set(filter(None, found[k]["labels"].split(","))) == labels, texts[k]
        assert found[k]["score"] == 1 if kept[k] == 1 else found[k]["score"] <= 1
        if kept[k] == 1:
            assert found[k]["spans"][0]["start"] == 9
    assert all(found[len(texts) + k]["labels"] == "" and found[len(texts) + k]["score"] == 0 for k in range(len(NOT)))


@pytest.mark.parametrize("seed", range(30))
def test_best_chain_matches_brute_force(seed):
    r = random.Random(seed)
    matches = sorted({(r.randint(3, 40), r.randint(3, 30), r.randint(1, 6)) for _ in range(12)})
    gap = r.randint(0, 6)

    def longest(k):
        end, template, length = matches[k]
        best = length
        for j, (e, t, _) in enumerate(matches):
            skipped, apart = end - length - e, template - length - t
            overlap = max(0, -skipped, -apart)
            if e < end and t < template and skipped <= gap and apart <= gap and overlap < length:
                best = max(best, longest(j) + length - overlap)
        return best

    assert max(c for _, _, c in licenses.chain(matches, gap)) == max(map(longest, range(len(matches))))


def test_many_notices_in_one_text(spark):
    notice = licenses.TEMPLATES["isc"][0]
    took = []
    for n in (1000, 4000):
        began = time.time()
        row = _labels(spark, [f"{notice} and then " * n])[0]
        took.append(time.time() - began)
        assert row["labels"] == "isc" and len(row["spans"]) == n
    assert took[1] < 8 * took[0] + 2


@pytest.mark.parametrize(
    ("text", "labels", "spans"),
    [
        ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "cc-by-sa", ["cc-by-sa"]),
        ("This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.", "cc-by-nd", ["cc-by-nd"]),
        ("This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.", "cc-by-nc-sa", ["cc-by-nc-sa"]),
        ("This work is licensed under a Creative Commons Attribution-Zlib 4.0 International License.", "", []),
        ("Licensed under CC BY-NC-ND 4.0", "cc-by-nc-nd", ["cc-by-nc-nd"]),
        ("Licensed under the Eclipse Public License, Version 2.0", "epl", ["epl"]),
        ("Licensed under the Boost Public License, Version 2.0", "", []),
        (licenses.TEMPLATES["lgpl"][0], "gpl,lgpl", ["lgpl"]),  # the contract's phrase "general public license" stands in it
        (licenses.TEMPLATES["lgpl"][1].replace("library", "program"), "gpl,lgpl", ["lgpl"]),
        (" ".join(licenses.TEMPLATES["agpl"]), "agpl,gpl", ["agpl", "agpl"]),
        (licenses.TEMPLATES["gpl"][0], "gpl", ["gpl"]),
        ("Released under the MIT License, Apache tools excepted", "mit", ["mit"]),
    ],
)
def test_words_that_tell_licences_apart(spark, text, labels, spans):
    row = _labels(spark, [f"see below {text} thank you"])[0]
    assert row["labels"] == labels and [x["label"] for x in row["spans"]] == spans
