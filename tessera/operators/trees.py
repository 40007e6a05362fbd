"""Post bodies as trees, walked by a recursive query over VARIANT: a level of all trees at each step."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tessera.registry import query

#: Children keep their place below their parent's, so that places in order are the reading order.
_WALK = """with recursive node(id, place, tree) as (
  select id, cast(array() as array<int>), tree from (select id, try_parse_json(body) as tree from {bodies}) where try_variant_get(tree, '$.type', 'string') = 'doc'
  union all
  select node.id, concat(node.place, array(child.pos)), child.value
  from node, lateral variant_explode(case when schema_of_variant(try_variant_get(node.tree, '$.content', 'variant')) like 'ARRAY%' then try_variant_get(node.tree, '$.content', 'variant') end) child),
image(id, place, key) as (select id, place, try_variant_get(tree, '$.attrs["data-public-id"]', 'string') from node
  where try_variant_get(tree, '$.type', 'string') = 'image' and schema_of_variant(try_variant_get(tree, '$.attrs["data-public-id"]', 'variant')) = 'STRING'),
one(id, key, place) as (select id, key, min(place) from image where key rlike '\\\\S' group by id, key),
listed(id, images) as (select id, transform(sort_array(collect_list(struct(place, key))), x -> x.key) from one group by id)
select b.id, case when try_variant_get(try_parse_json(b.body), '$.type', 'string') = 'doc' then coalesce(l.images, array()) end as images from {bodies} b left join listed l on l.id = b.id"""


def images_in(bodies: DataFrame) -> DataFrame:
    """id, images of bodies(id, body): the ids of image nodes in reading order, each once; null unless the body is a tree whose root is a
    document. Trees of any depth; ids are distinct."""
    spark = bodies.sparkSession
    for limit in ("Row", "Level"):
        spark.conf.set(f"spark.sql.cteRecursion{limit}Limit", "-1")
    return spark.sql(_WALK, bodies=bodies)


#: Images below id % 5 blocks, one of them twice, between texts; blank ids; other roots; no JSON.
_TREES = """select id, case when id % 11 = 3 then 'no tree' when id % 11 = 4 then concat('{"type":"p","content":[{"type":"image","attrs":{"data-public-id":"a', id, '"}}]}')
  else concat('{"type":"doc","content":[', repeat('{"type":"quote","content":[{"type":"text"},', cast(id % 5 as int)), '{"type":"image","attrs":{"data-public-id":"a', id, '"}},{"type":"image","attrs":{"data-public-id":" "}}', repeat(']}', cast(id % 5 as int)),
    ',{"type":"image","attrs":{"data-public-id":"b', id % 3, '"}},{"type":"list","content":[{"type":"image","attrs":{"data-public-id":"a', id, '"}},{"type":"image","attrs":{"data-public-id":"c', id, '"}}]},{"type":"image","attrs":{}}]}') end as body from users"""
query("json_tree_walk", "select id, case when id % 11 not in (3, 4) then ['a' || id, 'b' || (id % 3), 'c' || id] end as images from users")(lambda t: images_in(t.sql(_TREES)))
