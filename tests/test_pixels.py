import struct
import zlib

import numpy as np
import pytest

from shardflow.functions import tensors as N
from shardflow.operators import pixels
from shardflow.plans import png_files as P


def dense(n_in, n_out):
    """``(n_out, n_in)`` weights of a triangle around each output centre, from the definition."""
    scale = n_in / n_out
    width = max(scale, 1.0)
    w = np.array([[max(0.0, 1 - abs(k + 0.5 - (x + 0.5) * scale) / width) for k in range(n_in)] for x in range(n_out)])
    return w / w.sum(axis=1, keepdims=True)


@pytest.mark.parametrize("sizes", [(8, 4), (2, 4), (1, 7), (7, 1), (300, 512), (640, 512), (512, 100), (5, 5)])
def test_taps_are_the_weights_that_count(sizes):
    at, w = N.bilinear_taps(*sizes)
    spread = np.zeros(sizes[::-1])
    for place, weight in zip(at, w):
        np.add.at(spread, (np.arange(sizes[1]), place), weight)
    assert np.allclose(spread, dense(*sizes)) and at.min() >= 0 and at.max() < sizes[0]
    assert len(w) <= 2 * max(1, sizes[0] / sizes[1]) + 1


def test_whole_numbers_against_whole_sums_and_fractions():
    a = np.random.default_rng(3).integers(0, 256, (1, 64, 80, 3)).astype(np.int64)
    bits, half = 1 << N.WEIGHT_BITS, 1 << (N.WEIGHT_BITS - 1)
    whole = lambda *sizes: np.floor(dense(*sizes) * bits + 0.5).astype(np.int64)
    for h, w in ((51, 64), (100, 93), (3, 200)):
        got = N.resize_stack(a.astype(np.uint8), h, w)
        wide = (np.einsum("xk,nykc->nyxc", whole(80, w), a) + half) // bits
        assert got.dtype == np.uint8 and (got == (np.einsum("yk,nkxc->nyxc", whole(64, h), wide) + half) // bits).all()
        wide = np.floor(np.einsum("xk,nykc->nyxc", dense(80, w), a) + 0.5)
        off = np.abs(got - np.einsum("yk,nkxc->nyxc", dense(64, h), wide))
        assert off.max() <= 1.5  # 0.5, or one more where a tie falls the other way between the axes


def test_weights_of_a_halved_axis():
    w = dense(8, 4)
    assert w[1] == pytest.approx(np.array([0, 1, 3, 3, 1, 0, 0, 0]) / 8)
    assert w[0] == pytest.approx(np.array([3, 3, 1, 0, 0, 0, 0, 0]) / 7)
    assert dense(2, 4)[1] == pytest.approx([0.75, 0.25])
    assert np.allclose(dense(300, 512).sum(axis=1), 1)


@pytest.mark.parametrize("rounding", ["uint8", "none"])
def test_resize_against_loops(rounding):
    a = np.random.default_rng(2).integers(0, 256, (2, 5, 7, 3)).astype(np.uint8)
    got = N.resize_stack(a, 3, 9, rounding)
    step = (lambda v: min(255, max(0, int(v + 0.5)))) if rounding == "uint8" else (lambda v: v)
    wide, tall = dense(7, 9), dense(5, 3)
    for n in range(2):
        for c in range(3):
            rows = [[step(sum(wide[x, k] * a[n, y, k, c] for k in range(7))) for x in range(9)] for y in range(5)]
            for y in range(3):
                for x in range(9):
                    assert got[n, y, x, c] == pytest.approx(step(sum(tall[y, k] * rows[k][x] for k in range(5))))


def test_resize_keeps_constant_images_and_size():
    a = np.full((1, 4, 6, 3), 200, np.uint8)
    assert (N.resize_stack(a, 512, 512) == 200).all()
    b = np.arange(72, dtype=np.uint8).reshape(1, 4, 6, 3)
    assert (N.resize_stack(b, 4, 6) == b).all()


def filtered_png(a, kinds):
    """A PNG whose rows use the given filters."""
    h, w, c = a.shape
    full = np.zeros((h + 1, w + 1, c), int)
    full[1:, 1:] = a
    body = b""
    for y in range(h):
        left, up, corner = full[y + 1, :-1], full[y, 1:], full[y, :-1]
        guess = left + up - corner
        near = np.abs(np.stack([guess - left, guess - up, guess - corner])).argmin(axis=0)
        paeth = np.choose(near, [left, up, corner])
        base = [0, left, up, (left + up) // 2, paeth][kinds[y]]
        body += bytes([kinds[y]]) + ((a[y].astype(int) - base) % 256).astype(np.uint8).tobytes()
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    head = struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2, 4: 6}[c], 0, 0, 0)
    return P.PNG_SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(body)) + chunk(b"IEND", b"")


@pytest.mark.parametrize("c", [1, 3, 4])
def test_png_filters(c):
    a = np.random.default_rng(c).integers(0, 256, (5, 6, c), dtype=np.uint8)
    assert (P.png_pixels(filtered_png(a, [0, 1, 2, 3, 4])) == a).all()
    assert (P.png_pixels(filtered_png(a, [4, 3, 1, 2, 4])) == a).all()
    assert (P.png_pixels(P.png_bytes(a)) == a).all()


def test_payloads_to_tensors_with_bad_ones(spark):
    rng = np.random.default_rng(5)
    arrays = {k: rng.integers(0, 256, (4 + k % 2, 6, 3), dtype=np.uint8) for k in range(40)}
    rows = [(k, P.png_bytes(a)) for k, a in arrays.items()] + [(99, b"broken")]
    decoded = pixels.decode_payloads(spark.createDataFrame(rows, "id int, payload binary"), ["id"], decoder=P.png_decoder)
    bad = decoded.where("error is not null").collect()
    assert len(bad) == 1 and "not a PNG" in bad[0].error
    good = decoded.where("error is null")
    got = {r.id: r for r in pixels.resize_to_tensor(good, ["id"], 2, 3).collect()}
    assert set(got) == set(arrays)
    for k, a in arrays.items():
        want = N.resize_stack(a[None], 2, 3)[0].transpose(2, 0, 1) / 255
        assert (got[k].c, got[k].h, got[k].w) == (3, 2, 3)
        assert got[k].px == pytest.approx(want.ravel(), abs=1e-6)
    other = {r.id: r.px for r in pixels.tensor_then_resize(good, ["id"], 2, 3).collect()}
    assert all(np.abs(np.array(other[k]) - got[k].px).max() < 1.1 / 255 for k in arrays)
    for scale_first, want in ((False, {k: r.px for k, r in got.items()}), (True, other)):
        source = spark.createDataFrame(rows, "id int, payload binary").repartition(3)
        way = dict(payload="payload", scale_first=scale_first, decoder=P.png_decoder)
        loaded = pixels.load_tensors(source, ["id"], 2, 3, packed=False, **way).collect()
        assert [r.id for r in loaded if r.error] == [99] and len(loaded) == 41
        assert {r.id: r.px for r in loaded if r.error is None} == want
        packed = pixels.load_tensors(source, ["id"], 2, 3, mode="DROPMALFORMED", **way).collect()
        assert {r.id: np.frombuffer(r.px, "<f4").tolist() for r in packed} == want
        with pytest.raises(Exception, match="not a PNG"):
            pixels.load_tensors(source, ["id"], 2, 3, mode="FAILFAST", **way).collect()
    sized = pixels.resize_images(good, ["id"], 2, 3).first()
    assert (sized.height, sized.width, len(sized.pixels)) == (2, 3, 18)
    flat = {r.id: r.px for r in pixels.to_tensor(good, ["id"]).collect()}
    assert flat[3] == pytest.approx(arrays[3].transpose(2, 0, 1).ravel() / 255, abs=1e-6)


def test_decoded_images_in_one_pass(spark, tmp_path):
    rng = np.random.default_rng(6)
    for k in range(6):
        (tmp_path / f"v{k}.png").write_bytes(P.png_bytes(rng.integers(0, 256, (5 + k % 2, 7, (1, 3, 4)[k % 3]), dtype=np.uint8)))
    decoded = spark.read.format("image").load(str(tmp_path)).selectExpr("image.origin as name", "image")
    one = sorted(map(tuple, pixels.images_to_tensor(decoded, ["name"], 4, 9).collect()))
    two = sorted(map(tuple, pixels.resize_to_tensor(pixels.rgb_images(decoded, ["name"]), ["name"], 4, 9).collect()))
    assert one == two and len(one) == 6


def test_missing_decoder_is_one_clear_error(spark):
    def absent():
        raise ImportError("decoding encoded bytes needs Pillow on every worker, or another decoder")

    df = spark.createDataFrame([(1, b"x")], "id int, payload binary")
    for call in (pixels.decode_payloads, lambda *a, **k: pixels.load_tensors(*a, 2, 2, payload="payload", **k)):
        with pytest.raises(Exception, match="needs Pillow on every worker"):
            call(df, ["id"], mode="PERMISSIVE", decoder=absent).collect()
