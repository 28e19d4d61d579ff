"""Plain HTML tables are read without the parser, and alike."""

import random

from pagetally.operators.tables import _Grid, _plain_grid


def grid_of(text):
    grid = _Grid()
    grid.feed(text)
    grid.close()
    while grid.open:
        grid.handle_endtag("table")
    return grid.tables


def test_plain_tables_as_the_parser_reads_them():
    rng = random.Random(4)
    parts = ["<table>", "</table>", "<tr>", "</TR>", "<td>", "</td>", "<td colspan='2'>", '<th rowspan="3" class="a b">', "<td colspan=2 rowspan=x>", "<td colspan=''>", "</th>", "<br>", " a\n b ", "1 > 0", "٣", "<tbody>"]
    plain = 0
    for _ in range(3000):
        text = "<table>" + "".join(rng.choices(parts, k=rng.choice([2, 8, 20])))
        got = _plain_grid(text)
        if got is not None:
            plain += 1
            while got.open:
                got.handle_endtag("table")
            assert got.tables == grid_of(text), text
    assert plain == 3000
    for text in ("<table><tr><td>a&amp;b", "<table><!-- <td> -->", "<table><td>a<b>c", "<table><tr><td", "<script><table></script>", "<table><td/>", "<table></td x>"):
        assert _plain_grid(text) is None
