"""License copies with inserted words, against containment in stretches of every length up to the limit."""

import random
import re

import numpy as np
import pyarrow as pa

from ebbflow.llm import licenses

from .conftest import words

MIT = ('Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation '
       'files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use')


def shingles(text):
    w = re.findall(r"[a-z0-9]+", text.lower())
    return [tuple(w[i:i + 5]) for i in range(len(w) - 4)]


def brute(text):
    """Licenses of which some stretch, of any length up to the limit, holds 0.8 of a template's shingles."""
    have, out = shingles(text), set()
    for name, texts in licenses.TEMPLATES.items():
        for t in texts:
            want = set(shingles(t))
            most = len(want) if len(want) < 5 else 2 * len(want)
            if any(len(want & set(have[i:i + most])) >= 0.8 * len(want) for i in range(len(have))):
                out.add(name)
    return out


def found(texts):
    hits = dict(licenses.Scanner().scan(pa.array(texts)))
    return [hits.get(i, []) for i in range(len(texts))]


def test_real_mit_wording():
    rng = random.Random(1)
    text = f"{words(rng, 30)} {MIT} {words(rng, 30)}"
    (name, begin, end, share), = found([text])[0]
    assert (name, share) == ("MIT", 1.0) and MIT.startswith(text[begin:end]) and text[begin:end].endswith("without restriction")


def test_insertions_do_not_hide_a_copy():
    rng = random.Random(3)
    texts = []
    for n in range(300):
        notice = rng.choice(rng.choice(sorted(licenses.TEMPLATES.values()))).split()
        for _ in range(rng.randrange(3)):       # inserted runs of any length, words left out or replaced
            at = rng.randrange(1, len(notice))
            notice[at:at + rng.randrange(2)] = words(rng, rng.choice([0, 1, 2, 9, 60])).split()
        texts.append(f"{words(rng, 20)} {' '.join(notice)} {words(rng, 20)}")
    got, expected = [{h[0] for h in hits} for hits in found(texts)], [brute(t) for t in texts]
    pairs = {(i, name) for i, names in enumerate(expected) for name in names}
    seen = {(i, name) for i, names in enumerate(got) for name in names}
    assert seen <= pairs and len(pairs) > 100
    assert len(seen) >= 0.99 * len(pairs)               # the bands are probabilistic


def test_bands_are_likely_to_meet_every_template():
    scanner = licenses.Scanner()
    assert min(licenses.collision_probability(n) for n in scanner.sizes) > 0.999


def test_signatures_decide_what_is_retrieved():
    """Lazily made signatures give what those of all windows give."""
    rng = random.Random(8)
    scanner = licenses.Scanner()
    for t, name in enumerate(scanner.names):
        notice = [x for texts in licenses.TEMPLATES.values() for x in texts][t].split()
        cut = notice[:rng.randrange(6, len(notice) + 1)] if len(notice) > 6 else notice
        text = f"{words(rng, rng.randrange(40))} {' '.join(cut)} {words(rng, rng.randrange(90))} {' '.join(notice)}"
        own = licenses._shingles(text)
        size, step = licenses.grid(scanner.sizes[t])
        agree = set()
        for start in range(0, len(own), step):
            signature = licenses._signature(own[start:start + size])
            if (signature == scanner.signatures[t]).reshape(licenses.BANDS, licenses.ROWS).all(axis=1).any():
                agree |= set(range(start, min(start + size, len(own))))
        at, number = scanner.held(own)
        places = np.array([i for i, x in zip(at.tolist(), number.tolist()) if t in scanner.users[x]])
        assert {k for a, b in scanner.retrieved(t, own, places) for k in range(a, b)} == agree != set()


def test_scattered_fragments_are_no_copy():
    rng = random.Random(4)
    notice = MIT.split()
    parts = [" ".join(notice[i:i + 8]) for i in range(0, len(notice) - 4, 4)]
    rng.shuffle(parts)
    text = " ".join(f"{p} {words(rng, 500)}" for p in parts)
    assert found([text]) == [[]]
    near = " ".join(notice[:14] + words(rng, 9).split() + notice[14:])
    assert {h[0] for h in found([near])[0]} == {"MIT"}


def test_each_copy_is_a_place():
    one = licenses.TEMPLATES["BSD"][0]
    text = f"Redistribution and use in source and other things. {one} {one} and between {one}"
    assert [text[h[1]:h[2]] for h in found([text])[0]] == [one] * 3
