"""Texts made to be slow, and items too short for the usual q-grams."""

import random
import time

import pytest

from ledgerlens.llm import decontam, pii
from tests.llm import brute

MEGABYTE = 1_000_000


@pytest.mark.parametrize("text", [
    "7" * MEGABYTE, "a" * MEGABYTE + "@", "=" * MEGABYTE, " " * MEGABYTE, "a@" * (MEGABYTE // 2), "token=" * (MEGABYTE // 6), "1.1.1." * (MEGABYTE // 6),
    "+1 " * (MEGABYTE // 3), "x://" * (MEGABYTE // 4), "IBAN " * (MEGABYTE // 5), "a" * (MEGABYTE // 2) + "@" + "b" * (MEGABYTE // 2)])
def test_personal_data_in_a_megabyte_of_one_pattern(text):
    start = time.process_time()
    pii.spans(text)
    assert time.process_time() - start < 20


def test_addresses_and_numbers_after_long_runs():
    assert pii.spans("a" * 50_000 + "@b.cc") == [(0, 50_005, "email")]
    assert pii.spans("x@" * 1000 + "b.cc") == [(1998, 2004, "email")]
    assert pii.spans("9" * 30_000 + ".300.1.1 1.2.3.4")[-1] == (30_009, 30_016, "ip")


@pytest.mark.parametrize("text,secret", [
    ("apiKey=abcdefgh1", "abcdefgh1"), ("API_Key: abcdefgh1", "abcdefgh1"), ('{"password": "hunter2hunter2"}', "hunter2hunter2"), ("Ä Token='abcdefgh1'", "abcdefgh1")])
def test_secrets_in_mixed_case_and_quotes(text, secret):
    assert [text[a:b] for a, b, kind in pii.spans(text) if kind == "secret"] == [secret]


@pytest.mark.parametrize("length", list(range(1, 21)) + [24, 25, 26])
def test_short_items_equal_alignment(length):
    rnd = random.Random(length)
    for _ in range(60):
        item = decontam.normal("".join(rnd.choice("abcdefgh") for _ in range(length)))
        data = bytearray(item)
        for _ in range(rnd.choice((0, 1, 1, 2))):
            at, what = rnd.randrange(len(data) + 1), rnd.random()
            if what < 0.4 and at < len(data):
                data[at] = rnd.choice(b"xyzw")
            elif what < 0.7 and at < len(data):
                del data[at]
            else:
                data.insert(at, rnd.choice(b"xyzw"))
        text = decontam.normal("".join(rnd.choice("mnop ") for _ in range(30)) + data.decode() + " mnop")
        distance, edits = brute.occurrence(item, text), int(len(item) * decontam.EDITS)
        assert decontam.matches(decontam.Index([(3, item)]), text.decode()) == ([(3, distance)] if distance <= edits else [])


def test_repetitive_items_equal_alignment():
    rnd = random.Random(7)
    for k in range(40):
        item = decontam.normal(rnd.choice(["=" * 120, "ab" * 50, "=" * 60 + "end of it" + "=" * 60, "- " * 40 + "x", "abcabc" * 12 + "title of the page"]))
        data = bytearray(item)
        for _ in range(rnd.randint(0, 8)):
            data[rnd.randrange(len(data))] = ord("z")
        text = decontam.normal(rnd.choice(["", "words before ", "=" * 30]) + data.decode() + rnd.choice(["", " after", "=" * 300]))
        distance = brute.occurrence(item, text)
        assert decontam.matches(decontam.Index([(1, item)]), text.decode()) == ([(1, distance)] if distance <= int(len(item) * decontam.EDITS) else [])


@pytest.mark.parametrize("text", ["=" * MEGABYTE, "=-" * (MEGABYTE // 2), "the same words again " * (MEGABYTE // 21)])
def test_decontamination_of_a_megabyte_of_one_pattern(text):
    items = [(1, decontam.normal("=" * 120)), (2, decontam.normal("the same words again " * 20)), (3, decontam.normal("a passage of some length that is not there"))]
    start = time.process_time()
    found = [i for i, _ in decontam.matches(decontam.Index(items), text)]
    assert time.process_time() - start < 60
    assert found == ([1] if text.startswith("==") else [2] if text.startswith("the") else [])


def test_windows_lose_no_occurrence(monkeypatch):
    monkeypatch.setattr(decontam, "PAIRS", 50)
    rnd = random.Random(1)
    item = decontam.normal("a passage of some length that a benchmark asks about")
    other = decontam.normal("another passage of some length that nobody asks about")
    for _ in range(30):
        text = " ".join(rnd.choice([item.decode(), other.decode(), "passage of some", "length that"]) for _ in range(rnd.randint(1, 30)))
        got = [i for i, _ in decontam.matches(decontam.Index([(1, item), (2, other)]), text)]
        assert got == [i for i, t in ((1, item), (2, other)) if brute.occurrence(t, decontam.normal(text)) <= int(len(t) * decontam.EDITS)]
