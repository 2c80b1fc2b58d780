"""Numeric column functions of points, cameras and colours."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Normalisation constants of the real spherical harmonics of degree 0 to 3.
SH_0 = 0.28209479177387814
SH_1 = 0.4886025119029199
SH_2 = (1.0925484305920792, -1.0925484305920792, 0.31539156525252005, -1.0925484305920792, 0.5462742152960396)
SH_3 = (-0.5900435899266435, 2.890611442640554, -0.4570457994644658, 0.3731763325901154, -0.4570457994644658, 1.445305721320277, -0.5900435899266435)
LEAST_OPACITY = 1e-6


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def logit(p: Column, eps: float = LEAST_OPACITY) -> Column:
    """The inverse of ``sigmoid``, bounded; NaN stays NaN."""
    q = F.greatest(F.lit(eps), F.least(p, F.lit(1 - eps)))
    return F.when(F.isnan(p), p).otherwise(F.log(q / (1 - q)))


def base_color(dc: Column) -> Column:
    """A colour channel from its constant harmonic, within [0, 1]."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.5 + SH_0 * dc))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def unit(v: Column) -> Column:
    """The vector of length one, or zeros if it has none."""
    n = norm(v)
    return F.transform(v, lambda x: F.when(n > 1e-12, x.cast("double") / n).otherwise(0.0))


def cosine(a: Column, b: Column) -> Column:
    n = norm(a) * norm(b)
    return F.when(n > 1e-24, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / n)))


def quaternion_matrix(q: Column) -> Column:
    """The nine entries, row by row, of the rotation of (w, x, y, z), which need not have length one."""
    n = F.greatest(norm(q), F.lit(1e-12))
    w, x, y, z = (F.get(q, F.lit(i)).cast("double") / n for i in range(4))
    return F.array(1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y), 2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x), 2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y))


def matrix_quaternion(rotation: Column) -> Column:
    """The unit quaternion (w, x, y, z) of nine entries of a rotation, row by row, with its first component that is not zero above zero; null entries give null.

    Four times the products of its greatest component with all four are sums of
    entries; the greatest is found first, so that none is divided by a small number.
    """
    m = lambda i, j: F.get(rotation, F.lit(3 * i + j)).cast("double")
    a, b, c = m(2, 1) - m(1, 2), m(0, 2) - m(2, 0), m(1, 0) - m(0, 1)
    d, e, f = m(0, 1) + m(1, 0), m(0, 2) + m(2, 0), m(1, 2) + m(2, 1)
    squares = [1 + m(0, 0) + m(1, 1) + m(2, 2), 1 + m(0, 0) - m(1, 1) - m(2, 2), 1 - m(0, 0) + m(1, 1) - m(2, 2), 1 - m(0, 0) - m(1, 1) + m(2, 2)]
    products = [F.array(squares[0], a, b, c), F.array(a, squares[1], d, e), F.array(b, d, squares[2], f), F.array(c, e, f, squares[3])]
    greatest = F.greatest(*squares)
    row = products[3]
    for i in (2, 1, 0):
        row = F.when(squares[i] == greatest, products[i]).otherwise(row)
    leading = F.get(F.filter(row, lambda x: x != 0), F.lit(0))
    complete = (F.size(rotation) == 9) & ~F.exists(rotation, lambda x: x.isNull())
    return F.when(complete, F.transform(row, lambda x: x / norm(row) * F.sign(leading)))


def sh_basis(x: Column, y: Column, z: Column, degree: int) -> list[Column]:
    """The real spherical harmonics of a unit direction up to ``degree``, 3 at most."""
    basis: list[Column] = [F.lit(SH_0)]
    if degree > 0:
        basis += [-SH_1 * y, SH_1 * z, -SH_1 * x]
    if degree > 1:
        basis += [SH_2[0] * x * y, SH_2[1] * y * z, SH_2[2] * (2 * z * z - x * x - y * y), SH_2[3] * x * z, SH_2[4] * (x * x - y * y)]
    if degree > 2:
        basis += [
            SH_3[0] * y * (3 * x * x - y * y),
            SH_3[1] * x * y * z,
            SH_3[2] * y * (4 * z * z - x * x - y * y),
            SH_3[3] * z * (2 * z * z - 3 * x * x - 3 * y * y),
            SH_3[4] * x * (4 * z * z - x * x - y * y),
            SH_3[5] * z * (x * x - y * y),
            SH_3[6] * x * (x * x - 3 * y * y),
        ]
    return basis


def sh_color(coefficients: Column, direction: Column, degree: int) -> Column:
    """The three channels of channel-major coefficients seen from a direction, zero at least."""
    d = unit(direction)
    basis = sh_basis(*(F.get(d, F.lit(i)) for i in range(3)), degree)
    n = len(basis)
    channels = []
    for c in range(3):
        total = F.lit(0.5)
        for k, b in enumerate(basis):
            total = total + b * F.get(coefficients, F.lit(c * n + k)).cast("double")
        channels.append(F.greatest(F.lit(0.0), total))
    return F.array(*channels)


def sh_degree(rest: Column) -> Column:
    """The degree whose count of further coefficients is 3 * ((d + 1) ** 2 - 1); null if none fits."""
    found = F.when(rest == 0, 0)
    for d in (1, 2, 3):
        found = found.when(rest == 3 * ((d + 1) ** 2 - 1), d)
    return found


def resize_harmonics(sh: Column, have: int, want: int) -> Column:
    """Channel-major coefficients padded with zeros or cut, channel by channel, to another degree."""
    a, b = (have + 1) ** 2, (want + 1) ** 2
    return F.array(*[F.get(sh, F.lit(c * a + k)) if k < a else F.lit(0.0) for c in range(3) for k in range(b)])


def focal_from_35mm(focal: Column, width: Column, height: Column) -> Column:
    """Focal length in pixels from its 35 mm equivalent: diagonals of the image and of 36 by 24 mm."""
    return focal * F.sqrt(width * width + height * height) / (36.0**2 + 24.0**2) ** 0.5


def rescale_intrinsics(k: Sequence[Column], sx: Column, sy: Column) -> list[Column]:
    """(fx, fy, cx, cy) for an image scaled by (sx, sy)."""
    return [k[0] * sx, k[1] * sy, k[2] * sx, k[3] * sy]


def parallax(a: Column, b: Column, point: Column) -> Column:
    """The angle in degrees between two rays from camera centres to a point."""
    to = lambda c: F.zip_with(point, c, lambda x, y: x.cast("double") - y.cast("double"))
    return F.degrees(F.acos(cosine(to(a), to(b))))


def reprojection_error(u: Column, v: Column, seen_u: Column, seen_v: Column) -> Column:
    return F.sqrt((u - seen_u) * (u - seen_u) + (v - seen_v) * (v - seen_v))


def json_safe(x: Column) -> Column:
    """A number that JSON can hold: non-finite becomes null."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def fit_rectangle(width: Column, height: Column, target: int) -> list[Column]:
    """(scale, x0, y0, w, h) of an image resized into a square of ``target`` with its aspect kept and centred."""
    scale = target / F.greatest(width, height)
    w, h = F.rint(width * scale), F.rint(height * scale)
    return [scale, F.floor((target - w) / 2), F.floor((target - h) / 2), w, h]


def initial_probability(member: Column, prior: Column) -> Column:
    """A class probability to start from: the membership's share, the prior's if it is greater, .05 at least."""
    return F.greatest(F.lit(0.05), 0.9 * member + 0.05, F.coalesce(prior, F.lit(0.05)))


def normalized_row(position: Column, scale: Column, color: Column, opacity: Column, rotation: Column) -> list[Column]:
    """A viewer's row: scale and colour in bounds, opacity in [0, 1], rotation of length one or the identity."""
    keep = lambda v, low, high: F.transform(v, lambda x: F.greatest(F.lit(low), F.least(F.coalesce(x, F.lit(low)), F.lit(high))))
    n = norm(rotation)
    turn = F.when(n > 1e-12, F.transform(rotation, lambda x: x / n)).otherwise(F.array(*[F.lit(x) for x in (1.0, 0.0, 0.0, 0.0)]))
    return [position, keep(scale, 1e-6, 1e6), keep(color, 0.0, 1.0), F.greatest(F.lit(0.0), F.least(F.coalesce(opacity, F.lit(1.0)), F.lit(1.0))), turn]


def triangulated(a: Sequence[Column], b: Sequence[Column], rotation: Column, shift: Column) -> Column:
    """The point, in the first camera's frame, nearest to the rays through two normalised pixels; null for parallel rays.

    The second camera sees x as rotation * x + shift; ``rotation`` is an array of
    rows.  The rays are met at the middle of their common perpendicular.
    """
    ray = [a[0], a[1], F.lit(1.0)]
    other = [b[0], b[1], F.lit(1.0)]
    dot = lambda x, y: x[0] * y[0] + x[1] * y[1] + x[2] * y[2]
    turned = [sum(rotation[j][i] * other[j] for j in range(3)) for i in range(3)]
    centre = [-sum(rotation[j][i] * shift[j] for j in range(3)) for i in range(3)]
    aa, bb, ab = dot(ray, ray), dot(turned, turned), dot(ray, turned)
    ac, bc = dot(ray, centre), dot(turned, centre)
    det = aa * bb - ab * ab
    s, t = (ac * bb - bc * ab) / det, (ac * ab - bc * aa) / det
    point = F.array(*[(s * ray[i] + centre[i] + t * turned[i]) / 2 for i in range(3)])
    return F.when(F.abs(det) > 1e-12 * aa * bb, point)


def pixel_map_problem(pixels: Column, width: Column, height: Column) -> Column:
    """The first frame of a map of frame to pixel whose pixel is not a finite pair inside its frame, null if all are."""
    inside = lambda p, w, h: (F.size(p) == 2) & ~F.isnan(p[0]) & ~F.isnan(p[1]) & (p[0] >= 0) & (p[0] < w) & (p[1] >= 0) & (p[1] < h)
    ok = lambda e: F.coalesce(inside(e["value"], F.try_element_at(width, e["key"]), F.try_element_at(height, e["key"])), F.lit(False))
    return F.array_min(F.transform(F.filter(F.map_entries(pixels), lambda e: ~ok(e)), lambda e: e["key"]))
