"""The engine: registered queries against SQL, exhaustive transforms, the codec's round trips and its refusal of damage."""

import json
import os
import struct

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from voxelframe import arrays, catalog, cli
from voxelframe.codec import container, entropy, tiff
from voxelframe.codec.model import Model, normalize_row, read_varint, varint
from voxelframe.functions import transform as X
from voxelframe.operators import pixels as P
from voxelframe.operators import statistics as S
from voxelframe.plans import jobs, spec
from voxelframe.plans.spec import MODES, Calibration, Dims, FormatError, Options
from voxelframe.sources import stack

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_matches_sql(spark, db, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = df.select(*columns).collect()
    if name in catalog.ORACLES:
        want = db.sql("SELECT " + ", ".join(f'"{c}"' for c in columns) + f" FROM ({catalog.ORACLES[name]})").fetchall()
        assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    else:
        assert got


@pytest.fixture(scope="module")
def wide(tmp_path_factory):
    """The tables with some events whose samples take more than 16 bits; and their views."""
    folder = tmp_path_factory.mktemp("wide")
    con = duckdb.connect()
    for t in TABLES:
        os.symlink(f"{SF}/{t}.parquet", folder / f"{t}.parquet") if t != "events" else con.execute(f"COPY (SELECT * REPLACE (value + CASE WHEN event_id % 197 = 5 THEN 700 ELSE 0 END AS value) FROM '{SF}/events.parquet') TO '{folder}/events.parquet'")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    assert con.sql("SELECT count(*) FROM events WHERE value * 100 > 65535").fetchall() == [(6,)]  # in six of ten planes
    return str(folder), con


@pytest.mark.parametrize("name", "ag14_plane_crc ec1_ec4_roundtrip ec2_lossy_roundtrip sc12_write_and_read sc17_tiff_planes sk18_convert sk1_encode_stats sk2_lossy_stats sc5_file_info sc28_headers mt3_metadata sk8_export".split())
def test_samples_above_16_bits_match_sql(spark, wide, name):
    folder, con = wide
    df = catalog.QUERIES[name](spark, folder)
    columns = sorted(df.columns)
    want = con.sql("SELECT " + ", ".join(f'"{c}"' for c in columns) + f" FROM ({catalog.ORACLES[name]})").fetchall()
    assert sorted(map(repr, map(tuple, df.select(*columns).collect()))) == sorted(map(repr, want))


@pytest.mark.parametrize("name", "ec1_ec4_roundtrip ec2_lossy_roundtrip sc12_write_and_read sk1_encode_stats sk2_lossy_stats".split())
def test_far_outliers_match_sql(spark, tmp_path, name):
    con = duckdb.connect()
    con.execute(f"COPY (SELECT * REPLACE (CASE event_id % 97 WHEN 5 THEN 1424.84 WHEN 6 THEN 1424.85 + event_id WHEN 7 THEN 42949672.95 ELSE value END AS value) FROM '{SF}/events.parquet') TO '{tmp_path}/events.parquet'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    df = catalog.QUERIES[name](spark, str(tmp_path))
    columns = sorted(df.columns)
    want = con.sql("SELECT " + ", ".join(f'"{c}"' for c in columns) + f" FROM ({catalog.ORACLES[name]})").fetchall()
    assert sorted(map(repr, map(tuple, df.select(*columns).collect()))) == sorted(map(repr, want))


def test_a_stack_of_no_events_is_read_as_no_rows(spark, tmp_path):
    duckdb.connect().execute(f"COPY (SELECT * FROM '{SF}/events.parquet' WHERE false) TO '{tmp_path}/events.parquet'")
    none, some = (catalog.QUERIES["sc12_write_and_read"](spark, str(d)) for d in (tmp_path, SF))
    assert none.collect() == [] and none.dtypes == some.dtypes


def test_symbols_above_255_need_a_saturated_end():
    cal = Calibration(100.0, 0.46, 2.0)
    v = np.array([[[0, 65535, 142021, 142022, 2**32 - 1]]])
    data, stats = container.encode_volume(v, calibration=cal)
    assert container.decode_volume(data)[0, 0, 1:].tolist() == container.rebuilt(container.quantised(v[0, 0, 1:], cal), cal).tolist()
    assert stats["q_max"] == container.quantised(v.max(), cal) > 255
    for cal in (Calibration(0, 1, 2), Calibration(509, 1, 2)):  # 255 decodes to 65025 and to 65534
        with pytest.raises(FormatError, match="256"):
            container.encode_volume(np.array([[[0, 65536 + int(cal.offset)]]]), calibration=cal)
    assert container.decode_volume(container.encode_volume(np.array([[[66046]]]), calibration=Calibration(510, 1, 2))[0]).item() == 65535


def test_wide_streams_are_verified():
    v = np.array([[[0, 65535, 65536, 2**32 - 1], [7, 8, 9, 70000]]] * 3)
    data, stats = container.encode_volume(v, Options(2))
    assert (container.decode_volume(data) == v).all() and stats["q_max"] == 65535 and stats["total_bytes"] == len(data)
    noted = container.set_metadata(data, b"a note")
    assert container.get_metadata(noted) == b"a note" and (container.decode_container(noted) == v).all()
    narrow = len(container.encode_volume(v & 65535, Options(2))[0])
    for bad in (data[:-1], data[:narrow], data + b"x", *(data[:i] + bytes([data[i] ^ 1]) + data[i + 1 :] for i in range(narrow, len(data)) if i - narrow not in (18, 19))):  # all but the inner flags
        with pytest.raises(FormatError):
            container.decode_volume(bad)
    for wrong in (-1, 2**32):
        with pytest.raises(FormatError):
            container.encode_volume(np.full((1, 1, 2), wrong))
    with pytest.raises(FormatError, match="16 bits"):
        arrays.ArrayForm((2,), "x", np.dtype("<u2")).array(np.full((1, 1, 1, 1, 2), 65536))


def test_packed_planes_refuse_what_they_cannot_hold(spark):
    voxels = spark.createDataFrame([(0, 0, 0, 0, x, v) for x, v in enumerate((3, 70000))], "t long, c long, z long, y long, x long, v long")
    for packed in (P.planes, lambda v: jobs.pack_planes(v, 2, 1)):
        assert [r["v"] for r in jobs.voxels_of(packed(voxels), 2).orderBy("x").collect()] == [3, 70000]
        with pytest.raises(Exception, match="samples must lie in"):
            packed(voxels.withColumn("v", -F.col("v"))).collect()


# --- transforms -------------------------------------------------------------------------------------------------
def half_away(x):
    return int(x) + (x - int(x) >= 0.5)


def test_transforms_over_the_whole_range(spark):
    import math

    rows = spark.range(65536).select(F.col("id").alias("v"), X.q_symbol(F.col("id")).alias("q"), X.rebuild(X.q_symbol(F.col("id")), X.remainder(F.col("id"))).alias("back")).collect()
    assert all(r["q"] == math.isqrt(r["v"]) and r["back"] == r["v"] for r in rows)
    for cal in (Calibration(), Calibration(100, 0.46, 2), Calibration(0.5, 0.25, 1.5), Calibration(-3, 2, 0.7)):
        got = spark.range(65536).select(F.col("id").alias("v"), X.quantize(F.col("id"), cal).alias("q")).withColumn("back", X.reconstruct(F.col("q"), cal)).collect()
        for r in got:
            q = half_away(2 * math.sqrt(max((r["v"] - cal.offset) * cal.gain, 0)) / cal.step)
            z = q * cal.step
            assert r["q"] == q and r["back"] == min(max(half_away(max(cal.offset + 0.25 * z * z / cal.gain, 0)), 0), 65535)


def test_too_large_values_are_errors(spark):
    with pytest.raises(Exception, match="exceeds 65535"):
        spark.range(1).select(X.rebuild(F.lit(256), F.lit(0))).collect()
    with pytest.raises(FormatError, match="256"):
        container.encode_volume(np.array([[[0, 65535, 65025]]]), calibration=Calibration(0, 1, 2))
    container.encode_volume(np.array([[[65025, 0, 1]]]), calibration=Calibration(0, 1, 2))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 10**6), min_size=1, max_size=300), st.sampled_from([256, 512, 1024, 2048]))
def test_normalized_rows(counts, total):
    counts = np.array(counts)
    if not counts.any() or (counts > 0).sum() > total:
        return
    f = normalize_row(counts, total)
    assert f.sum() == total and ((f > 0) == (counts > 0)).all()


def test_normalization_in_sql_equals_the_row_function(spark):
    rng = np.random.default_rng(1)
    rows, want = [], {}
    for g, counts in enumerate([rng.integers(1, 3, 200), np.append(rng.integers(1, 2, 250), 10**9), np.array([5]), rng.integers(0, 1000, 40), np.array([1] * 255 + [900, 900]), np.array([7, 7, 7])]):
        rows += [(g, s, int(n)) for s, n in enumerate(counts)]
        want |= {(g, s): int(f) for s, f in enumerate(normalize_row(counts, 256 if len(counts) < 257 else 512)) if f}
    df = spark.createDataFrame(rows, "g int, s int, n long")
    for size, groups in ((256, "g not in (4)"), (512, "g in (4)")):
        for r in S.normalize_counts(df.where(groups), ["g"], "s", "n", size.bit_length() - 1).collect():
            if (r["g"], r["s"]) in want and (len([x for x in rows if x[0] == r["g"]]) < 257) == (size == 256):
                assert want[r["g"], r["s"]] == r["freq"], r


# --- the codec --------------------------------------------------------------------------------------------------
def test_few_blocks_and_many_are_coded_alike(monkeypatch):
    rng = np.random.default_rng(7)
    arrays_ = [rng.poisson(m, (5, 6, 7)) for m in (0, 3, 900, 30000)]
    for mode in MODES:
        for cal in (None, Calibration(100, 0.46, 4)):
            done = []
            for few in (0, 1 << 30):
                monkeypatch.setattr(entropy, "FEW", few)
                done.append([data for data, _ in container.encode_volumes(arrays_, Options(2, mode), cal)])
                assert cal or all((a == b).all() for a, b in zip(container.decode_volumes(done[-1]), arrays_))
            assert done[0] == done[1]
            back = []
            for few in (0, 1 << 30):
                monkeypatch.setattr(entropy, "FEW", few)
                back.append(container.decode_volumes(done[0]))
            assert all((a == b).all() for a, b in zip(*back))


def test_many_small_volumes_take_bounded_memory():
    import tracemalloc

    rng = np.random.default_rng(3)
    light, dense = [rng.poisson(900, (2, 20, 25)) for _ in range(300)], [rng.integers(0, 65536, (2, 5, 15)) for _ in range(300)]
    for arrays_ in (light, dense):  # the first are coded, the others' models are the largest
        tracemalloc.start()
        streams = [data for data, _ in container.encode_volumes(arrays_, Options(2))]
        encoding = tracemalloc.get_traced_memory()[1]
        tracemalloc.reset_peak()
        assert all((a == b).all() for a, b in zip(container.decoded_volumes(streams), arrays_, strict=True))
        decoding = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert max(encoding, decoding) < 2 * container.WORK_BYTES, (encoding, decoding)


@pytest.mark.parametrize("depths", [(3, 2), (2, 2, 1)], ids=["sc28_headers", "sc2_payload_check"])
def test_chunks_of_the_header_queries_take_bounded_memory(depths):
    import tracemalloc

    rng = np.random.default_rng(4)
    arrays_ = [np.round(rng.exponential(5000, (d, 4, 25))).astype(np.int64) for _ in range(120) for d in depths]
    arrays_[7][0, 0, 0] = 70000  # one that takes more than 16 bits
    tracemalloc.start()
    done = container.encode_volumes(arrays_, Options(block_depth=2))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2 * container.WORK_BYTES, peak
    assert [struct.unpack_from("<IIII", data, 8) for data, _ in done] == [(25, 4, d, 2) for _ in range(120) for d in depths]


@st.composite
def volumes(draw):
    """Volumes of a few blocks: counts of light, ramps, or values around the powers of two and the squares."""
    shape = tuple(draw(st.integers(1, n)) for n in (6, 7, 9))
    rng = np.random.default_rng(draw(st.integers(0, 2**32)))
    kind = draw(st.sampled_from(["light", "ramp", "edges"]))
    if kind == "light":
        return rng.poisson(draw(st.sampled_from([0.1, 20, 3000])), shape).clip(0, 65535)
    if kind == "ramp":
        return (np.indices(shape) * rng.integers(1, 3000, (3, 1, 1, 1))).sum(0) % 65536
    near = np.concatenate([1 << np.arange(17), np.arange(0, 256, 5) ** 2])
    return (rng.choice(near, shape) + rng.integers(-1, 2, shape)).clip(0, 65535)


@settings(max_examples=40, deadline=None)
@given(volumes(), st.sampled_from(sorted(MODES)), st.integers(8, 11), st.integers(1, 4))
def test_volumes_come_back(v, mode, bits, depth):
    if len(np.unique(np.floor(np.sqrt(v)))) > 1 << bits or 2 * np.sqrt(v.max()) >= 1 << bits:
        bits = 11
    data, stats = container.encode_volume(v, Options(depth, mode, bits))
    assert (container.decode_volume(data) == v).all() and stats["blocks"] == -(-len(v) // depth)
    cal = Calibration(0, 1, 4.1)
    q = container.symbols(v, cal)
    back = container.symbols(container.decode_volume(container.encode_volume(v, Options(depth, mode), cal)[0]), cal)
    assert np.abs(back - q).max() <= 1


def test_contexts_equal_the_window_query(spark):
    for mode in MODES:
        rows = {r["i"]: (r["q"], r["ctx"]) for r in P.contexts(P.px_events(spark, SF), P.EVENTS, Options(mode=mode)).collect()}
        q = np.array([rows[i][0] for i in range(1000)]).reshape(2, 5, 4, 25)
        for c in range(2):
            for z in (0, 4):
                own = entropy.block_contexts(q[None, c, z : z + 4], mode, int(q[c].max()) + 1).ravel()
                assert own.tolist() == [rows[c * 500 + z * 100 + k][1] for k in range(len(own))]


def test_blocks_that_cannot_be_coded_are_stored():
    rng = np.random.default_rng(3)
    # of a dark volume, the block of its last plane
    v = np.zeros((65, 3, 3), dtype=np.int64)
    v[-1] = rng.integers(0, 65536, (3, 3))
    data, stats = container.encode_volume(v, Options(64))
    assert [b.raw for b in container.parse_volume(data).blocks] == [False, True] and stats["raw_blocks"] == 1 and (container.decode_volume(data) == v).all()
    # a volume of noise only is as long as its pixels and the framing
    alone = [len(container.encode_volume(rng.integers(0, 65536, (n, 40, 30)), Options(2))[0]) - 2 * n * 1200 for n in (2, 4, 6)]
    assert alone[0] < 100 and alone[1] - alone[0] == alone[2] - alone[1] < 50
    dark = container.encode_volume(np.zeros((4, 9, 8)), calibration=Calibration(37, 0.5, 1.5))[0]
    assert (container.decode_volume(dark) == 37).all()


def test_every_bit_flip_is_refused():
    v = np.random.default_rng(0).poisson(900, (3, 5, 5))
    for data in (container.encode_volume(v)[0], container.encode_volume(v, calibration=Calibration(100, 0.46, 2))[0]):
        for i in range(8 * len(data)):
            if i // 8 in (6, 7):  # the flags are outside the checksum
                continue
            bad = bytearray(data)
            bad[i // 8] ^= 1 << i % 8
            with pytest.raises(FormatError):
                container.decode_volume(bytes(bad))


def test_model_bytes():
    rng = np.random.default_rng(5)
    m = Model.from_counts(50, 40, 10, rng.integers(0, 50, 400), rng.integers(0, 40, 400))
    back = Model.load(m.dump())
    assert (back.freq == m.freq).all() and (back.active == m.active).all()
    for n in range(len(m.dump())):
        with pytest.raises(FormatError):
            Model.load(m.dump()[:n])
    assert [read_varint(varint(n), 0)[0] for n in (0, 127, 128, 2**32 - 1)] == [0, 127, 128, 2**32 - 1]
    for bad in (b"\x80", b"\x80\x00", b"\xff\xff\xff\xff\x7f"):
        with pytest.raises(FormatError):
            read_varint(bad, 0)


def test_containers_and_metadata():
    rng = np.random.default_rng(2)
    v = rng.poisson(500, (2, 2, 7, 4, 3))
    d = Dims(3, 4, 7, 2, 2)
    streams = [container.encode_volume(v[t, c])[0] for t in range(2) for c in range(2)]
    packed = container.pack_collection(d, streams, False)
    chunks = [(t, c, z, min(3, 7 - z), container.encode_volume(v[t, c, z : z + 3])[0]) for t in range(2) for c in range(2) for z in (0, 3, 6)]
    stream = container.stream_header(d, 3, 12, False) + b"".join(container.chunk_record(*x) for x in chunks)
    for data in (packed, stream):
        for metadata in (b"", b"short", b"long " * 1000):
            noted = container.set_metadata(data, metadata)
            assert container.get_metadata(noted) == metadata and (container.decode_container(noted) == v).all()
            assert container.set_metadata(noted, b"") == data
        for cut in (1, 30, 45, len(data) // 2, len(data) - 1):
            with pytest.raises((FormatError, struct.error)):
                container.decode_container(data[:cut])
        with pytest.raises(FormatError):
            container.decode_container(data + b"x")
    swapped = container.stream_header(d, 3, 12, False) + b"".join(container.chunk_record(*x) for x in chunks[::-1])
    with pytest.raises(FormatError, match="order"):
        container.decode_container(swapped)
    noted = bytearray(container.set_metadata(packed, b"abc"))
    noted[-20] ^= 1
    with pytest.raises(FormatError):
        container.get_metadata(bytes(noted))
    with pytest.raises(FormatError):
        container.set_metadata(packed, b"abc", limit=2)


# --- jobs, sources, streams -------------------------------------------------------------------------------------
def test_source_prunes_units_and_writes_atomically(spark, tmp_path):
    stack.register(spark)
    path = str(tmp_path / "a.vox")
    chunks = jobs.encode_chunks(jobs.pack_planes(P.px_events(spark, SF), 25, 4), 25, 4, 2)
    options = {"x": 25, "y": 4, "z": 5, "c": 2, "t": 1, "chunkDepth": 2}
    chunks.write.format("voxelstack").mode("append").options(**options).save(path)
    got = spark.read.format("voxelstack").load(path)
    assert got.count() == 10 and got.where("z = 4 and c = 0").count() == 1
    reader = stack.StackReader({"path": path})
    from pyspark.sql.datasource import EqualTo, GreaterThan

    list(reader.pushFilters([EqualTo(("c",), 1), GreaterThan(("z",), 3)]))
    assert [(u.c, u.z0) for p in reader.partitions() for u in p.units] == [(1, 4)]
    with pytest.raises(Exception, match="a.vox"):
        chunks.write.format("voxelstack").mode("append").options(**options).save(path)
    with pytest.raises(Exception, match="declared"):
        chunks.where("z0 > 0").write.format("voxelstack").mode("append").options(**options).save(str(tmp_path / "b.vox"))
    assert sorted(os.listdir(tmp_path)) == ["a.vox"]


def test_missing_planes_are_errors(spark):
    planes = jobs.pack_planes(P.px_events(spark, SF), 25, 4)
    with pytest.raises(Exception, match="do not make chunk"):
        jobs.encode_chunks(planes.where("z <> 1"), 25, 4, 5).collect()


def test_stream_emits_whole_chunks(spark, tmp_path):
    from voxelframe.streaming.ingest import encode_stream

    planes = jobs.pack_planes(P.px_events(spark, SF), 25, 4).cache()
    folder = str(tmp_path / "in")
    planes.where("z < 3").coalesce(1).write.mode("append").parquet(folder)
    planes.where("z >= 3").coalesce(1).write.mode("append").parquet(folder)
    source = spark.readStream.schema(planes.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    query = encode_stream(source, 25, 4, 5, 2).writeStream.format("memory").queryName("chunks_out").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    chunks = spark.table("chunks_out")
    assert sorted((r["c"], r["z0"], r["depth"]) for r in chunks.collect()) == [(c, z, d) for c in (0, 1) for z, d in ((0, 2), (2, 2), (4, 1))]
    back = {(r["c"], r["z"]): bytes(r["pixels"]) for r in jobs.decode_chunks(chunks).collect()}
    assert back == {(r["c"], r["z"]): bytes(r["pixels"]) for r in planes.collect()}


# --- arrays, files, TIFF, command line --------------------------------------------------------------------------
@st.composite
def images(draw):
    """An array of any axes in any order, in memory as it comes: of either byte order, transposed, cut and reversed."""
    axes = draw(st.permutations(["y", "x", *draw(st.lists(st.sampled_from("tcz"), unique=True))]))
    shape = [draw(st.integers(1, 5)) for _ in axes]
    dtype = draw(st.sampled_from(["u1", "<u2", ">u2"]))
    whole = np.random.default_rng(draw(st.integers(0, 2**32))).integers(0, np.iinfo(dtype).max + 1, [2 * n for n in shape[::-1]]).astype(dtype)
    steps = tuple(slice(None, None, draw(st.sampled_from([2, -2]))) for _ in shape)
    return whole[steps].T, "".join(axes)


@settings(max_examples=40, deadline=None)
@given(images())
def test_arrays(image):
    a, axes = image
    data = arrays.compress(a, axes, metadata=b"note:1\n{}\n")
    back = arrays.decompress(data)
    assert np.array_equal(back, a) and back.dtype == a.dtype
    frame = arrays.encode_chunk(a, axes)
    assert np.array_equal(arrays.decode_chunk(frame, a.shape, axes, a.dtype.str), a)
    with pytest.raises(FormatError):
        arrays.decode_chunk(frame[:-1] + bytes([frame[-1] ^ 1]), a.shape, axes, a.dtype.str)
    with pytest.raises(FormatError):
        arrays.decompress(data, max_output_bytes=2 * a.size - 1)


def test_only_the_own_record_is_read_as_one(tmp_path):
    a = np.arange(24, dtype="u2").reshape(2, 3, 4)
    data = arrays.compress(a, metadata=b"user")
    for note in (b"note:1\n{\"a\": 1}\n", b"{}", b"\0", arrays.ArrayForm.MARK[:-1]):
        path = tmp_path / "n.vox"
        path.write_bytes(container.set_metadata(data, note))
        assert arrays.open_file(str(path)).metadata == note and (arrays.read(str(path)) == a).all()
    record = arrays.ArrayForm.of(a, None).record()
    for i in range(len(arrays.ArrayForm.MARK), len(record)):
        with pytest.raises(FormatError):
            arrays.decompress(container.set_metadata(data, record[:i] + bytes([record[i] ^ 1]) + record[i + 1 :]))


def test_lazy_files(tmp_path):
    a = np.random.default_rng(1).poisson(300, (3, 7, 9)).astype("u2")
    path = str(tmp_path / "a.vox")
    arrays.write(path, a, metadata=b"note")
    ds = arrays.open_file(path)
    assert ds.shape == (3, 7, 9) and ds.axes == "zyx" and ds.metadata == b"note"
    for key in (0, -1, slice(None, None, -1), (slice(0, 2), 3), (..., 4), (1, ..., slice(8, 2, -3)), (slice(5, 9),), (2, slice(1, 1)), (slice(None), -2, slice(None, None, 2)), ...):
        assert np.array_equal(ds[key], a[key]), key
    for bad in (3, (0, 0, 0, 0)):
        with pytest.raises(IndexError):
            ds[bad]
    with pytest.raises(FileExistsError):
        arrays.write(path, a)
    arrays.write(path, a[:1], overwrite=True)
    assert (arrays.read(path) == a[:1]).all() and os.listdir(tmp_path) == ["a.vox"]


def test_tiff_variants(tmp_path):
    rng = np.random.default_rng(4)
    planes = [rng.integers(0, 65536, (13, 21)) for _ in range(3)]
    data = tiff.write_pages(planes, 21, 13, "a note")
    pages = tiff.read_pages(container.read_bytes(data), len(data))
    assert len(pages) == 3 and pages[0].description == "a note"
    assert all((tiff.read_plane(container.read_bytes(data), p) == q).all() for p, q in zip(pages, planes))
    small = tiff.write_pages([np.full((2, 3), 300)], 3, 2, item=1)
    assert (tiff.read_plane(container.read_bytes(small), tiff.read_pages(container.read_bytes(small), len(small))[0]) == 255).all()
    assert tiff._unpackbits(bytes([2, 1, 2, 3, 254, 9, 128])) == b"\1\2\3\t\t\t"
    for bad in (b"", b"II*\0\xff\xff\xff\xff", data[:40]):
        with pytest.raises((FormatError, struct.error)):
            tiff.read_pages(container.read_bytes(bad), len(bad))


@pytest.mark.parametrize("big", [False, True])
def test_streamed_files(big):
    rng = np.random.default_rng(8)
    planes = [rng.integers(0, 65536, (5, 7)) for _ in range(4)]
    pieces = list(tiff.page_stream(iter(planes), 4, 7, 5, "a note", big=big))
    assert len(pieces) == 5  # the head, and one piece for each page
    data = b"".join(pieces)
    pages = tiff.read_pages(container.read_bytes(data), len(data))
    assert pages[0].description == "a note" and all((tiff.read_plane(container.read_bytes(data), p) == q).all() for p, q in zip(pages, planes))
    # a file beyond classic offsets becomes a big one by itself
    head = next(tiff.page_stream(iter(()), 3000, 1024, 1024))
    assert head[2:4] == b"+\0" and next(tiff.page_stream(iter(()), 3, 1024, 1024))[2:4] == b"*\0"
    with pytest.raises(FormatError):
        next(tiff.page_stream(iter(()), 3000, 1024, 1024, big=False))
    for wrong in (planes[:3], [*planes, planes[0]], [*planes[:3], planes[0][:4]]):
        with pytest.raises(FormatError):
            list(tiff.page_stream(iter(wrong), 4, 7, 5))


def test_frames_that_are_not_whole_leave_no_file(spark, tmp_path):
    from voxelframe.sources import tiff as frames

    planes = jobs.pack_planes(P.px_events(spark, SF), 25, 4)
    with pytest.raises(Exception, match="9 of 10 pages"):
        frames.write_frames(planes.where("c = 0 or z > 0"), f"file://{tmp_path}", 25, 4, 10).collect()
    assert not list(tmp_path.glob("*.tif"))
    assert frames.write_frames(planes, f"file://{tmp_path}", 25, 4, 10).collect() == [("frame-00000000.tif", 10)]
    assert frames.inspect(f"file://{tmp_path}/frame-00000000.tif")["planes"] == 10


def test_lzw():
    # clear, 7, 7 7 (258), 7 7 7 (259), end
    codes, bits = [256, 7, 258, 259, 257], ""
    bits = "".join(f"{c:09b}" for c in codes)
    raw = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    assert tiff._unlzw(raw) == b"\7" * 6


def test_command_line(tmp_path, capsys):
    v = np.random.default_rng(6).poisson(400, (2, 5, 2, 6, 8))  # t z c y x
    source = str(tmp_path / "s.tif")
    with open(source, "wb") as f:
        f.write(tiff.write_pages(v.reshape(-1, 6, 8), 8, 6, "ImageJ=1\nimages=20\nchannels=2\nslices=5\nframes=2\n"))
    out, back = str(tmp_path / "s.vox"), str(tmp_path / "b.tif")
    assert cli.main(["encode", source, out]) == 0 and cli.main(["decode", out, back]) == 0
    assert (cli.load_stack(back)[0] == v.transpose(0, 2, 1, 3, 4)).all()
    cli.main(["info", out])
    assert json.loads(capsys.readouterr().out)["shape"] == [2, 2, 5, 6, 8]
    with pytest.raises(FileExistsError):
        cli.main(["encode", source, out])
    with pytest.raises(FormatError):
        cli.main(["encode", source, source])
    assert cli.main(["encode-lossy", source, out, "--offset", "100", "--gain", "0.5", "--force"]) == 0
    assert cli.main(["benchmark", source, "--repeats", "1"]) == 0
    assert json.loads(capsys.readouterr().out)["max_abs"] == 0
    with pytest.raises(SystemExit):
        cli.main(["encode", source, out, "--block-depth", "0"])


# --- planners ---------------------------------------------------------------------------------------------------
def test_planners():
    assert Options(0, "mean", 0) == Options(4, "mean", 10)
    for bad in ({"scale_bits": 7}, {"scale_bits": 12}, {"mode": "median"}):
        with pytest.raises(FormatError):
            Options(**bad)
    for bad in ({"gain": 0}, {"step": -1}, {"offset": float("nan")}):
        with pytest.raises(FormatError):
            Calibration(**bad)
    assert spec.default_axes(3) == "zyx" and spec.canonical_shape((7, 3), "xy") == Dims(7, 3, 1)
    for bad in ("xx", "zy", "abyx"):
        with pytest.raises(FormatError):
            spec.check_axes(bad)
    assert spec.default_chunks((1, 1, 40, 2048, 2048), "tczyx") == (1, 1, 4, 512, 512)
    assert spec.default_chunks((40, 4096, 4096), "zyx", side=1024) == (4, 1024, 1024)
    assert spec.default_chunks((40, 4096, 4096), "zyx", side=1024, limit=1 << 20) == (4, 256, 512)
    assert spec.stream_depth(Dims(1000, 1000, 300), 256 << 20, 4) == 32
    levels = spec.anisotropic_levels((100, 2048, 2048), (5, 0.5, 0.5))
    assert levels[1] == (1, 2, 2) and levels[-1] == (1, 8, 8)
    spec.check_levels(levels)
    for bad in ([(1, 2, 2)], [(1, 1, 1), (1, 1, 1)], [(1, 1, 1), (2, 2, 2), (3, 4, 4)]):
        with pytest.raises(FormatError):
            spec.check_levels(bad)
    assert spec.level_tile((64, 512, 512), (4, 512, 512), (2, 4, 4)) == (4, 256, 256)
    assert spec.resolve_dims(12, {"t": None, "c": 2, "z": None}, {"t": 3}) == {"t": 3, "c": 2, "z": 2}
    with pytest.raises(FormatError):
        spec.resolve_dims(12, {"c": 5}, {})
    assert spec.context_count(256, "mean") == 1025 and spec.context_count(256, "meansigns") == 2561
    assert spec.reciprocal_gain(4) == 0.25
    with pytest.raises(FormatError):
        spec.reciprocal_gain(0)
