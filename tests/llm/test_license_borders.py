"""License notices at the borders of neighbouring rows."""

import random

import pyarrow as pa

from ebbflow.llm import licenses

from .conftest import words


def test_notices_at_the_very_start_and_end_of_rows():
    rng = random.Random(5)
    scanner = licenses.Scanner()
    for name, texts in licenses.TEMPLATES.items():
        for notice in texts:
            half = len(notice.split()) // 2
            rows = [words(rng, 12), f"{notice} {words(rng, 9)}", words(rng, 12), f"{words(rng, 9)} {notice}", words(rng, 12),
                    notice, notice, None, "", " ".join(notice.split()[:half]), " ".join(notice.split()[half:])]
            alone = [dict(scanner.scan(pa.array([r], pa.string()))).get(0, []) for r in rows]
            together = dict(scanner.scan(pa.array(rows)))
            assert [together.get(i, []) for i in range(len(rows))] == alone
            assert [i for i in range(len(rows)) if name in {h[0] for h in together.get(i, [])}] == [1, 3, 5, 6]
