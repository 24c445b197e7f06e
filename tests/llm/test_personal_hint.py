"""Disguised identifiers do not depend on what else stands in the text."""

import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ebbflow.llm import pii

PIECES = ["eight", "dot", "plus", "one", "oh", "at", "(at)", "[ dot ]", "{punkt}", "< . >", "jane", "example", "org", "jane@example", "x@mail.de",
          "the", "-", "9", ".", "@", "(", ")", "four-five", "ONE", "Dot", "ſix", "٣", "é", "\n"]


@settings(max_examples=600, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=14), st.sampled_from([" ", "", "  "]))
def test_hint_loses_nothing(pieces, gap):
    text = gap.join(pieces)
    odd = not text.isascii() and pii._ODD.search(text)
    assert pii._disguised(text) == pii._undone(text, odd)


@pytest.mark.parametrize("text, kind, source", [
    ("server eight dot eight dot eight dot eight up", "ip", "eight dot eight dot eight dot eight"),
    ("write jane@example (punkt) org now", "email", "jane@example (punkt) org")])
def test_identifier_without_other_hints(text, kind, source):
    for context in ("", " or call plus four nine one five one two three four five six seven"):
        assert (kind, source) in [(k, (text + context)[a:b]) for k, a, b, _ in pii.find(text + context)]
    assert pii.redact(text) == text.replace(source, f"<{kind.upper()}>")


def test_space_before_no_sign_is_linear():
    assert pii.find(" " * 300_000 + "(" + " " * 300_000) == []


@pytest.mark.parametrize("text", ["seen at www.example.org today", "meet me at home.today ok", "contact us at www.example.org", "look at this.thing",
                                  "the address was at example.org"])
def test_prepositions_before_hosts_are_no_addresses(text):
    assert pii.find(text) == [] and pii.redact(text) == text


@pytest.mark.parametrize("text, source", [
    ("e-mail: jane at example.org, thanks", "jane at example.org"), ("her address is j.doe at mail.example.org", "j.doe at mail.example.org"),
    ("jane at example dot org", "jane at example dot org"), ("jane at example (dot) org", "jane at example (dot) org"),
    ("jane ( at ) example.org", "jane ( at ) example.org")])
def test_spoken_addresses(text, source):
    assert [(k, text[a:b], plain) for k, a, b, plain in pii.find(text)] == [("email", source, False)]


@pytest.mark.parametrize("text", [
    "jane (at) example (dot) org" + " " * 300_000 + "x", "jane" + " " * 300_000 + "(at) example (dot) org", "jane (at) example" + " " * 300_000 + ".",
    "a (at) b (dot) c " * 20_000, "x@y.zz " * 30_000 + "jane (at) example (dot) org", "(at)" + " " * 200_000 + "(at" + " " * 200_000,
    "jane at " * 60_000 + "example dot org", "mail: " * 60_000 + "jane at example.org"])
def test_disguises_take_linear_time(text):
    began = time.time()
    pii.find(text)
    assert time.time() - began < 10
