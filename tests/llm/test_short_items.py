"""Short items with equal words and different ids each give a row."""

from pixelweir.llm import decontaminate as D


def test_equal_short_items_are_all_found():
    items = D.Items.of([(7, "red fox"), (8, "Red  fox"), (9, "fox"), (10, "a longer item of many words")])
    found = sorted((t, items.ids[i], s, n) for t, i, s, n in D._matches(items, [b"the red fox and a red fox", b"red", b"fox"], D.LEAST))
    assert found == [(0, 7, 1.0, 2), (0, 8, 1.0, 2), (0, 9, 1.0, 2), (2, 9, 1.0, 1)]
