from __future__ import annotations

import json
import random

from tessera.operators.retrieval import image_ids
from tessera.operators.trees import images_in


def tree(r, depth):
    kind = r.choice(["image"] * 6 + ["p", "doc", 7, None])
    node = {"type": kind, "attrs": r.choice([{}, *[{"data-public-id": r.choice([f"i{r.randrange(9)}"] * 8 + ["é", " ", "\n", "", 5, None])}] * 3])}
    if depth:
        node["content"] = r.choice([[tree(r, depth - 1) for _ in range(r.randrange(5))]] * 4 + ["text", {"x": tree(r, 0)}, None])
    return r.choice([node, node, node, "leaf", 3, [node]]) if depth < 4 else node


def test_walk_against_the_stack(spark):
    r = random.Random(1)
    bodies = [json.dumps(tree(r, 5) | {"type": r.choice(["doc", "doc", "doc", "p"])}) for _ in range(200)]
    deep = '{"type":"doc","content":[' + '{"type":"b","content":[' * 150 + '{"type":"image","attrs":{"data-public-id":"deep"}}' + "]}" * 151
    rows = list(enumerate([*bodies, None, "", "no", "[]", '"doc"', '{"type":"doc"}', '{"type":"doc","content":[]}']))
    got = {x.id: x.images for x in images_in(spark.createDataFrame(rows, "id long, body string")).collect()}
    assert got == {i: image_ids(b) for i, b in rows} and max(len(v or []) for v in got.values()) > 3
    assert images_in(spark.createDataFrame([(1, deep)], "id long, body string")).first().images == ["deep"]
    assert images_in(spark.createDataFrame([], "id long, body string")).count() == 0
