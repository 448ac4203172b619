"""DuckDB SQL building blocks: common table expressions over the derived tables."""

from __future__ import annotations

import re

from . import fixtures as X

_CTE = {
    "nodes": X.NODES,
    "connectors": X.CONNECTORS,
    "edges": X.EDGES,
    "voxels": X.VOXELS,
    "points": X.POINTS,
    # nodes with parent distance, number of children and parent's columns
    "tree": """SELECT n.*, p.x AS px, p.y AS py, p.z AS pz, p.radius AS pradius, p.parent_id AS grand, coalesce(k.c, 0) AS kids,
  coalesce(sqrt((n.x-p.x)*(n.x-p.x) + (n.y-p.y)*(n.y-p.y) + (n.z-p.z)*(n.z-p.z)), 0) AS d
FROM nodes n LEFT JOIN nodes p ON p.neuron = n.neuron AND p.node_id = n.parent_id
LEFT JOIN (SELECT neuron, parent_id, count(*) AS c FROM nodes WHERE parent_id >= 0 GROUP BY 1, 2) k ON k.neuron = n.neuron AND k.parent_id = n.node_id""",
    # every node with all its ancestors, itself included
    "anc": """SELECT neuron, node_id, node_id AS a, parent_id AS up, CAST(0 AS BIGINT) AS hops, CAST(0 AS DOUBLE) AS dist, d AS step FROM tree
UNION ALL SELECT c.neuron, c.node_id, t.node_id, t.parent_id, c.hops + 1, c.dist + c.step, t.d
FROM anc c JOIN tree t ON t.neuron = c.neuron AND t.node_id = c.up WHERE c.up >= 0""",
    "root": "SELECT neuron, node_id, a AS root, hops AS depth, dist FROM anc WHERE up < 0",
    # synapses below each node, and in its whole component
    "syn": """SELECT r.neuron, r.node_id, r.root, coalesce(s.dp, 0) AS dp, coalesce(s.dq, 0) AS dq, coalesce(t.dp, 0) AS tp, coalesce(t.dq, 0) AS tq
FROM root r LEFT JOIN (SELECT a.neuron, a.a, sum(CAST(c.type = 'pre' AS INT)) AS dp, sum(CAST(c.type = 'post' AS INT)) AS dq
  FROM anc a JOIN connectors c ON c.neuron = a.neuron AND c.node_id = a.node_id GROUP BY 1, 2) s ON s.neuron = r.neuron AND s.a = r.node_id
LEFT JOIN (SELECT a.neuron, a.a, sum(CAST(c.type = 'pre' AS INT)) AS dp, sum(CAST(c.type = 'post' AS INT)) AS dq
  FROM anc a JOIN connectors c ON c.neuron = a.neuron AND c.node_id = a.node_id GROUP BY 1, 2) t ON t.neuron = r.neuron AND t.a = r.root""",
    # unbranched stretches: distal end, proximal end, length
    "seg": """SELECT a.neuron, a.node_id AS segment, min_by(a.a, a.hops) AS top, min(a.dist) AS length FROM anc a
JOIN tree f ON f.neuron = a.neuron AND f.node_id = a.node_id JOIN tree t ON t.neuron = a.neuron AND t.node_id = a.a
WHERE a.hops > 0 AND f.parent_id >= 0 AND f.kids <> 1 AND (t.kids <> 1 OR t.parent_id < 0) GROUP BY 1, 2""",
    # number of nodes below each node, itself included
    "below": "SELECT neuron, a AS node_id, count(*) AS size FROM anc GROUP BY 1, 2",
    # longest paths: each leaf belongs to the child with the farthest leaf
    "far": """SELECT a.neuron, a.a AS node_id, max(r.dist) AS far FROM anc a JOIN tree t ON t.neuron = a.neuron AND t.node_id = a.node_id AND t.kids = 0
JOIN root r ON r.neuron = a.neuron AND r.node_id = a.node_id GROUP BY 1, 2""",
    "heir": """SELECT neuron, parent_id AS node_id, min_by(node_id, (-far, node_id)) AS heir FROM
(SELECT t.neuron, t.parent_id, t.node_id, f.far FROM tree t JOIN far f ON f.neuron = t.neuron AND f.node_id = t.node_id WHERE t.parent_id >= 0) q GROUP BY 1, 2""",
    "path": """SELECT t.neuron, t.node_id AS leaf, t.node_id AS at FROM tree t WHERE t.kids = 0
UNION ALL SELECT p.neuron, p.leaf, h.node_id FROM path p JOIN heir h ON h.neuron = p.neuron AND h.heir = p.at""",
}
_NEEDS = {"connectors": ["nodes"], "voxels": ["nodes"], "points": ["nodes"], "tree": ["nodes"], "anc": ["tree"], "root": ["anc"], "syn": ["root", "connectors"], "seg": ["anc"], "below": ["anc"], "far": ["root"], "heir": ["far"], "path": ["heir"]}


def sql(body: str, *ctes: str, **more: str) -> str:
    """``body`` under the named table expressions and what they need; ``more`` are further ones, in order."""
    order: list[str] = []

    def add(name: str) -> None:
        for x in _NEEDS.get(name, []):
            add(x)
        if name not in order:
            order.append(name)

    for c in ctes:
        add(c)
    def kept(name: str, body: str) -> str:
        """Computed once; not so expressions that refer to themselves."""
        own = re.search(rf"\b(FROM|JOIN) {name}\b", body)
        return f"{name} AS {'' if own else 'MATERIALIZED '}({body})"

    parts = [kept(c, _CTE[c]) for c in order] + [kept(k, v) for k, v in more.items()]
    return ("WITH RECURSIVE " + ",\n".join(parts) + "\n" if parts else "") + body
