"""Notices next to each other, versions, and spans against a search of all substrings."""

import time

import pytest

from tidewake.llm import license_scan


def test_adjacent_notices_are_all_found():
    got = license_scan.scan_text("gnu generl public licnse version 2 gnu general public license version 3")
    assert got["labels"] == "gpl-2,gpl-3"
    assert [(s["label"], s["first_word"], s["edits"]) for s in got["spans"]] == [("gpl-2", 0, 2), ("gpl-3", 6, 0)]
    got = license_scan.scan_text("apache license versoin 2 apache license version 2")
    assert [(s["label"], s["first_word"], s["edits"]) for s in got["spans"]] == [("apache-2", 0, 2), ("apache-2", 4, 0)]


def test_a_match_that_reaches_into_its_neighbour_is_looked_for_again():
    got = license_scan.scan_text("apache license version apache license version 2")
    assert [s["first_word"] for s in got["spans"]] == [0, 3] and got["spans"][1]["edits"] == 0
    assert len(license_scan.scan_text("apache licence version 2 " * 3000)["spans"]) == 3000


def edit_distance(a: bytes, b: bytes) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def naive_spans(text: str) -> list[tuple[str, int, int]]:
    """(label, first word, edits) by the distance of every run of words to every notice; the nearest first, then disjoint ones."""
    words = license_scan.words_of(text)
    found = []
    for notice, label, k in license_scan.NOTICES:
        n, version = len(notice.split()), notice.split()[-1].encode()
        for i in range(len(words)):
            for size in range(max(1, n - 2), n + 3):
                some = words[i : i + size]
                if len(some) < size or (d := edit_distance(b" ".join(some), notice.encode())) > k:
                    continue
                number = next((w for w in [*some, *words[i + size : i + size + 1]] if w.isdigit()), version)
                if not version.isdigit() or number == version:
                    found.append((d, -len(b" ".join(some)), label, i, size))
    kept: list[tuple] = []
    for d, _, label, i, size in sorted(found):
        if all(i + size <= j or j + m <= i for _, j, _, m in kept):
            kept.append((label, i, d, size))
    return sorted((label, i, d) for label, i, d, _ in kept)


@pytest.mark.parametrize("text", [
    "code under the mit licence and under the mit license", "under teh mit license under the mit license", "GNU General Public Licence, version 3 or the GNU Lesser General Public License",
    "apache licens version 2 and mozila public license version 2", "gnu afero general public license", "Apache License Version 1.1", "GNU General Public License version 1", "Mozilla Public License Version 1",
    "redistribution and use in source and binary form " * 3, "gnu general public license version 2 gnu general public license version 3", "permission is hereby granted free of charge to any persn obtaining a copy", "nothing here",
])
def test_spans_equal_those_of_a_search_of_all_substrings(text):
    assert sorted((s["label"], s["first_word"], s["edits"]) for s in license_scan.scan_text(text)["spans"]) == naive_spans(text)


def test_other_versions_have_no_label():
    for text in ("Apache License Version 1.1", "GNU General Public License version 1", "Mozilla Public License Version 1.0", "gnu general public license version 21"):
        assert license_scan.scan_text(text)["labels"] == ""


def test_the_time_grows_with_the_text():
    def took(n):
        text, began = "released under the mit licence today\n" * n, time.process_time()
        assert len(license_scan.scan_text(text)["spans"]) == n
        return time.process_time() - began

    took(500)
    assert took(8000) < 6 * max(took(2000), 0.2)
