"""Planar geometry as SQL expressions over plain Spark types.

The functions take and return expression text, for ``expr`` and ``selectExpr``.

A point is two doubles. A polygon value is an array of polygons, each an array
of rings, each an array of vertices, each an array of two doubles. For lookups
an edge is a struct with its lower end first: ``(x1, y1, x2, y2)``, y1 <= y2.
"""

POLYGONS = r"(?is)^\\s*MULTIPOLYGON\\s*\\(\\s*\\(\\s*\\((.*)\\)\\s*\\)\\s*\\)\\s*$"
POLYGON = r"(?is)^\\s*POLYGON\\s*\\(\\s*\\((.*)\\)\\s*\\)\\s*$"
MORE_DIMENSIONS = r"(?i)^\\s*(MULTI)?POLYGON\\s*(Z|M|ZM)\\b"
EMPTY = r"(?i)^\\s*(MULTI)?POLYGON\\s+EMPTY\\s*$"
BETWEEN_POLYGONS = r"\\)\\s*\\)\\s*,\\s*\\(\\s*\\("
BETWEEN_RINGS = r"\\)\\s*,\\s*\\("


def point(x: str, y: str) -> str:
    return f"named_struct('x', cast({x} as double), 'y', cast({y} as double))"


def polygons_from_wkt(text: str) -> str:
    """Polygon text to the nested array; null if it is no (multi)polygon text.

    Numbers that do not parse come out as nulls, for ``polygon_fault`` to name.
    """
    body = f"""case when {text} rlike '{POLYGONS}' then regexp_extract({text}, '{POLYGONS}', 1)
                    when {text} rlike '{POLYGON}' then regexp_extract({text}, '{POLYGON}', 1) end"""
    vertex = r"transform(split(trim(pair), '\\s+'), number -> try_cast(number as double))"
    ring = f"transform(split(vertices, ','), pair -> {vertex})"
    polygon = f"transform(split(rings, '{BETWEEN_RINGS}'), vertices -> {ring})"
    return f"""case when {text} rlike '{EMPTY}' then cast(array() as array<array<array<array<double>>>>)
                    else transform(split({body}, '{BETWEEN_POLYGONS}'), rings -> {polygon}) end"""


def polygon_fault(text: str, polygons: str) -> str:
    """Why polygon text, parsed as given, cannot be used; null if it can."""

    def every_ring(test):
        return f"forall({polygons}, p -> forall(p, r -> {test}))"

    number = "n is not null and abs(n) < double('infinity')"
    numbers = every_ring(f"forall(r, v -> forall(v, n -> {number}))")
    pairs = every_ring("forall(r, v -> size(v) = 2)")
    closed = every_ring("size(r) >= 4 and element_at(r, 1) = element_at(r, -1)")
    return f"""case when {text} rlike '{MORE_DIMENSIONS}' then 'not two coordinates'
                    when {polygons} is null then 'not a polygon'
                    when not {numbers} then 'bad number'
                    when not {pairs} then 'not two coordinates'
                    when not {closed} then 'ring not closed' end"""


def ring_area(ring: str) -> str:
    """Signed area of a closed ring, positive if it runs counter-clockwise.

    Measured from the first vertex, so far-off coordinates cost no digits.
    """
    x, y = f"{ring}[0][0]", f"{ring}[0][1]"
    cross = f"(a[0] - {x}) * (b[1] - {y}) - (b[0] - {x}) * (a[1] - {y})"
    turns = f"zip_with({ring_starts(ring)}, {ring_ends(ring)}, (a, b) -> {cross})"
    return f"aggregate({turns}, 0D, (total, t) -> total + t) / 2"


def ring_starts(ring: str) -> str:
    return f"slice({ring}, 1, size({ring}) - 1)"


def ring_ends(ring: str) -> str:
    return f"slice({ring}, 2, size({ring}) - 1)"


def oriented(ring: str, is_shell: str) -> str:
    """The ring with its inside on the left: shells one way, holes the other."""
    return f"case when ({ring_area(ring)} < 0) = ({is_shell}) then reverse({ring}) else {ring} end"


def turn(e: str, x: str, y: str) -> str:
    """Positive left of an upward edge, negative right of it, zero in line."""
    return f"(({e}.x2 - {e}.x1) * ({y} - {e}.y1) - ({x} - {e}.x1) * ({e}.y2 - {e}.y1))"


#: Of the size of its two products, how far a turn in doubles may be off.
_DOUBT = 3.3306690738754716e-16


def side(e: str, x: str, y: str) -> str:
    """The sign of ``turn`` in exact arithmetic. Doubles decide where they surely can, and
    else the six products that a turn is made of, each as a sum of two doubles without
    error, are added up without error. Coordinates are below 1e150 in size."""
    first, second = f"({e}.x2 - {e}.x1) * ({y} - {e}.y1)", f"({x} - {e}.x1) * ({e}.y2 - {e}.y1)"
    doubt = f"{_DOUBT!r}D * (abs({first}) + abs({second}))"
    products = [(f"{e}.x2", y), (f"{e}.y1", x), (f"{e}.x1", f"{e}.y2"), (f"{e}.y1", f"-{e}.x2"), (y, f"-{e}.x1"), (f"{e}.y2", f"-{x}")]
    return f"""case when {first} - {second} > {doubt} then 1 when {second} - {first} > {doubt} then -1
                    else {_sign_of_sum([term for a, b in products for term in _product(a, b)])} end"""


def _product(a: str, b: str) -> tuple[str, str]:
    """A product in doubles, and what it is off by: from halves of 26 bits."""

    def high(v: str) -> str:
        return f"(134217729D * ({v}) - (134217729D * ({v}) - ({v})))"

    def low(v: str) -> str:
        return f"(({v}) - {high(v)})"

    whole = f"(({a}) * ({b}))"
    rest = f"((({whole} - {high(a)} * {high(b)}) - {low(a)} * {high(b)}) - {high(a)} * {low(b)})"
    return whole, f"({low(a)} * {low(b)} - {rest})"


def _sign_of_sum(terms: list[str]) -> str:
    """The sign of a sum of doubles. They are added one by one to a list of doubles that
    do not overlap, least first, whose sum is exact; the last of them that is not zero
    has the sign."""
    error = "(acc.q - (acc.q + v - (acc.q + v - acc.q))) + (v - (acc.q + v - acc.q))"
    grown = f"""aggregate(held, named_struct('q', t, 'done', cast(array() as array<double>)),
        (acc, v) -> named_struct('q', acc.q + v, 'done', concat(acc.done, array({error}))),
        acc -> concat(acc.done, array(acc.q)))"""
    whole = f"aggregate(array({', '.join(terms)}), cast(array() as array<double>), (held, t) -> {grown})"
    return f"int(signum(coalesce(try_element_at(filter({whole}, v -> v <> 0), -1), 0D)))"


def contains(edges: str, x: str, y: str, beyond: str = "0") -> str:
    """Is the point inside the edges' shape?

    The winding number: a ray to the right adds the weight ``w`` of every upward edge
    it crosses. ``beyond`` is the number where the ray ends, for edges that are only
    those near the point. Zones that overlap add up, so a point is inside if the number
    is not zero; on an edge, if it is not zero on any side of it. Sides are exact, without
    tolerance.
    """
    on = _passes(x, y)
    crosses = f"e.y1 <= {y} and {y} < e.y2 and {side('e', x, y)} > 0"
    start = f"aggregate(filter({edges}, e -> {crosses}), cast({beyond} as bigint), (n, e) -> n + e.w)"
    return f"""case when exists({edges}, e -> {on}) then forall({windings(edges, x, y, beyond)}, n -> n <> 0)
                    else {start} <> 0 end"""


def _passes(x: str, y: str) -> str:
    """Is the point on the edge?"""
    return f"""(e.y1 <= {y} and {y} <= e.y2 and {x} between least(e.x1, e.x2) and greatest(e.x1, e.x2)
                 and {side("e", x, y)} = 0)"""


def windings(edges: str, x: str, y: str, beyond: str = "0") -> str:
    """The winding numbers of the sectors around a point: the first lies just above the
    ray to the right, and each edge that leaves the point, counter-clockwise, adds or
    takes its weight. Angles are told apart to twelve digits."""
    crosses = f"e.y1 <= {y} and {y} < e.y2 and {side('e', x, y)} > 0"
    start = f"aggregate(filter({edges}, e -> {crosses}), cast({beyond} as bigint), (n, e) -> n + e.w)"

    def ray(end: str, weight: str) -> str:
        angle = f"atan2(e.y{end} - {y}, e.x{end} - {x})"
        turned = f"round(if({angle} <= 0, {angle} + 2 * pi(), {angle}), 12)"
        return f"if(e.x{end} = {x} and e.y{end} = {y}, null, named_struct('a', {turned}, 'w', {weight}))"

    on = f"filter({edges}, e -> {_passes(x, y)})"
    rays = f"filter(flatten(transform({on}, e -> array({ray('2', 'e.w')}, {ray('1', '-e.w')}))), r -> r is not null)"
    angles = f"array_sort(array_distinct(transform({rays}, r -> r.a)))"
    until = f"aggregate(filter({rays}, r -> r.a <= a), {start}, (n, r) -> n + r.w)"
    return f"concat(array({start}), transform({angles}, a -> {until}))"
