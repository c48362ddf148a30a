"""Vector functions, and exact nearest neighbours as ordered limits."""

from quern.queries import query, statements
from quern.operators.vector_search import knn_join
from quern.session import table

_Q = "(SELECT embedding FROM embeddings WHERE vec_id = 7)"
_W = "CAST(embedding AS DOUBLE[])"
_OW = f"(SELECT {_W} FROM embeddings WHERE vec_id = 7)"
_pair = "SELECT a.vec_id AS vec_id, ROUND({}, 5) AS x FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"
_A, _B = "CAST(a.embedding AS DOUBLE[])", "CAST(b.embedding AS DOUBLE[])"

statements({
    "vec_distance_l2": (_pair.format("VEC_DISTANCE_L2(a.embedding, b.embedding)"), _pair.format(f"list_distance({_A}, {_B})")),
    "vec_distance_operator": (_pair.format("a.embedding <=> b.embedding"), _pair.format(f"list_distance({_A}, {_B})")),
    "vec_distance_cosine": (_pair.format("VEC_DISTANCE_COSINE(a.embedding, b.embedding)"), _pair.format(f"greatest(1 - list_cosine_similarity({_A}, {_B}), 0)")),
    "vec_distance_ip": (_pair.format("VEC_DISTANCE_IP(a.embedding, b.embedding)"), _pair.format(f"-list_inner_product({_A}, {_B})")),
    "vec_dims": ("SELECT vec_id, VEC_DIMS(embedding) AS x FROM embeddings", "SELECT vec_id, len(embedding) AS x FROM embeddings"),
    "vec_norm": ("SELECT vec_id, ROUND(VEC_NORM(embedding), 5) AS x FROM embeddings", f"SELECT vec_id, round(sqrt(list_inner_product({_W}, {_W})), 5) AS x FROM embeddings"),
    "vec_to_text": ("SELECT VEC_TO_TEXT('[1, 2.5, 3]') AS x", "SELECT '[1.0, 2.5, 3.0]' AS x"),
    "vec_topk_l2": (f"SELECT vec_id, ROUND(embedding <=> {_Q}, 5) AS d FROM embeddings ORDER BY embedding <=> {_Q}, vec_id LIMIT 10", f"SELECT vec_id, round(list_distance({_W}, {_OW}), 5) AS d FROM embeddings ORDER BY list_distance({_W}, {_OW}), vec_id LIMIT 10"),
    "vec_topk_cosine": (f"SELECT vec_id FROM embeddings ORDER BY ROUND(VEC_DISTANCE_COSINE(embedding, {_Q}), 9), vec_id LIMIT 10", f"SELECT vec_id FROM embeddings ORDER BY round(greatest(1 - list_cosine_similarity({_W}, {_OW}), 0), 9), vec_id LIMIT 10"),
    "vec_topk_ip": (f"SELECT vec_id FROM embeddings ORDER BY ROUND(VEC_DISTANCE_IP(embedding, {_Q}), 9), vec_id LIMIT 10", f"SELECT vec_id FROM embeddings ORDER BY round(-list_inner_product({_W}, {_OW}), 9), vec_id LIMIT 10"),
    "vec_range_filter": (f"SELECT vec_id FROM embeddings WHERE embedding <=> {_Q} < 1.2", f"SELECT vec_id FROM embeddings WHERE list_distance({_W}, {_OW}) < 1.2"),
})


@query("vec_knn_join", f"""SELECT q, vec_id, r FROM (SELECT a.vec_id AS q, b.vec_id AS vec_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_distance({_A}, {_B}), 9), b.vec_id) AS r
    FROM embeddings a JOIN embeddings b ON a.vec_id < 20 AND a.vec_id <> b.vec_id) t WHERE r <= 3""")
def vec_knn_join(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return knn_join(e.filter("vec_id < 20"), e, 3)
