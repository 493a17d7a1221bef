"""Layout rules on crowded pages: against a plain definition, and within seconds."""

import random
import time

import pytest

from veilspark.operators import context as C
from veilspark.plans.packaging import ship

KINDS = "page int, line int, width double, height double, text string, x0 double, y0 double, x1 double, y1 double"
LABELS = {"RUT": "rut", "Nombre:": "name", "Correo": "email"}


@pytest.fixture(autouse=True)
def shipped(spark):
    ship(spark)


def pages(r, n, tops, height=12):
    rows = []
    for p in range(12):
        for i in r.sample(range(1000), n):
            x, y, wide = r.choice([20, 60, 130, 300]), r.choice(tops), r.choice([1, 40, 80, 80, 290, 340])
            text = r.choice([*LABELS, "valor", "valor", "uno dos tres cuatro cinco", "valor 7"])
            rows.append((p, i, 600.0, 800.0, text, float(x), float(y), float(x + wide), float(y + height)))
    return rows


def plain(rows):
    forms, columns = set(), set()
    for p in {v[0] for v in rows}:
        own = [v for v in rows if v[0] == p]
        for h in own:
            if h[4] not in LABELS:
                continue
            _, line, width, height, text, hx0, hy0, hx1, hy1 = h
            row = [v for v in own if v[1] != line and max(0, min(hy1, v[8]) - max(hy0, v[6])) / max(1e-6, min(hy1 - hy0, v[8] - v[6])) > 0.4]
            short = [v for v in row if len(v[4].split()) <= 4 and v[7] - v[5] < width / 2]
            if len(short) < 2:
                near = min(((v[5], v[1], v[4]) for v in row if v[5] >= hx1 - 2 and v[5] - hx1 < width * 0.45), default=None)
                if near and near[2] not in LABELS:
                    forms.add((p, line, LABELS[text], near[1]))
                continue
            left = max((v[7] for v in short if v[7] < hx0), default=None)
            right = min((v[5] for v in short if v[5] > hx1), default=None)
            start = (left + hx0) / 2 if left is not None else hx0 - (hy1 - hy0)
            end = (right + hx1) / 2 if right is not None else min(width, hx1 + 1.5 * (hx1 - hx0))
            last = hy1
            for v in sorted((v for v in own if v[6] > hy1 - 1 and start - 2 <= (v[5] + v[7]) / 2 <= end + 2), key=lambda v: (v[6], v[1])):
                if v[7] - v[5] > width * 0.55 or v[6] - last > max(4 * (hy1 - hy0), height * 0.08) or v[4] in LABELS:
                    break
                columns.add((p, line, LABELS[text], v[1]))
                last = v[8]
    return forms, columns


@pytest.mark.parametrize(("n", "tops"), [(5, range(40, 400, 40)), (14, [40, 58, 76, 94, 300]), (40, [40, 44, 58, 60, 130, 131, 230])])
def test_cells_equal_the_definition(spark, n, tops):
    r = random.Random(n)
    rows = pages(r, n, list(tops))
    df = spark.createDataFrame(rows, KINDS)
    forms, columns = plain(rows)
    assert {tuple(x) for x in C.form_cells(df, ["page"]).collect()} == forms
    assert {tuple(x) for x in C.column_cells(df, ["page"]).collect()} == columns
    assert forms or columns


@pytest.mark.parametrize("rule", [C.column_cells, C.form_cells])
def test_crowded_page(spark, rule):
    """40,000 lines in twenty places: their pairs are a thousand million, those of their boxes some hundreds."""
    lines = spark.range(40000).selectExpr(
        "1 as page", "id as line", "600.0D as width", "800.0D as height", "element_at(array('RUT', 'valor', 'Correo', 'valor'), cast(id % 4 as int) + 1) as text",
        "cast(20 + id % 5 * 110 as double) as x0", "cast(40 + id div 5 % 4 * 18 as double) as y0", "cast(100 + id % 5 * 110 as double) as x1", "cast(52 + id div 5 % 4 * 18 as double) as y1",
    )
    began = time.monotonic()
    rule(lines, ["page"]).count()
    assert time.monotonic() - began < 20
