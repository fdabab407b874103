import itertools
import json
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pelagia import nd
from pelagia.nd import Dataset, GridError, Variable
from pelagia.sources import formats, netcdf3


def rows(ds, columns=None, dimensions=None):
    return pa.Table.from_batches(list(nd.flatten(ds, columns, dimensions))).to_pylist()


def cube():
    return Dataset(
        {"time": 2, "lat": 3, "lon": 4},
        {
            "time": Variable(("time",), np.array([0, 1], np.int32), {"units": "days since 2020-01-01", "calendar": "standard"}),
            "lat": Variable(("lat",), np.array([-10.0, 0, 10], np.float32)),
            "lon": Variable(("lon",), np.arange(4.0)),
            "sst": Variable(("time", "lat", "lon"), np.arange(24, dtype=np.int16), {"scale_factor": 0.5, "add_offset": 1.0, "_FillValue": np.int16(3), "units": "degC"}),
        },
        {"title": "cube"},
    )


def shaped():
    ds = cube()
    ds.variables["sst"].values = ds.variables["sst"].values.reshape(2, 3, 4)
    return ds


def test_projection_decides_the_grid():
    ds = shaped()
    assert len(rows(ds)) == 24 and len(rows(ds, ["lat"])) == 3
    assert len(rows(ds, ["sst", "lat"])) == 24
    assert len(rows(ds, ["nothing"])) == 24
    got = rows(ds, ["sst", "time", "sst.units", ".title"])
    assert got[3]["sst"] is None and got[4]["sst"] == 3.0 and got[0]["sst.units"] == "degC" and got[0][".title"] == "cube"
    assert str(got[23]["time"]) == "2020-01-02 00:00:00"
    with pytest.raises(GridError):
        rows(ds, None, ["depth"])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=3), st.data())
def test_broadcast_equals_numpy(sizes, data):
    dims = [f"d{i}" for i in range(len(sizes))]
    pick = data.draw(st.sets(st.sampled_from(dims)))
    own = data.draw(st.permutations(sorted(pick)))
    full = dict(zip(dims, sizes))
    x = np.arange(int(np.prod([full[d] for d in own], dtype=int))).reshape([full[d] for d in own])
    flat, _ = nd.broadcast(Variable(tuple(own), x), dims, full)
    want = [x[tuple(at[dims.index(d)] for d in own)] for at in itertools.product(*map(range, sizes))]
    assert flat.tolist() == [int(v) for v in want]


def test_time_units():
    assert nd.time_units("seconds since 1970-01-01") == (10**6, 0)
    assert nd.time_units("hours since 2000-01-01 06:30:00 +02:00") == (3600 * 10**6, 946701000 * 10**6)
    assert nd.time_units("degC") is None and nd.time_units("parsecs since 2000-01-01") is None
    with pytest.raises(ValueError, match="noleap"):
        nd.time_units("days since 2000-01-01", "noleap")


def test_ragged():
    ds = Dataset(
        {"cast": 3, "obs": 5, "flag": 3},
        {
            "n": Variable(("cast",), np.array([2, 0, 3]), {"sample_dimension": "obs"}),
            "m": Variable(("cast",), np.array([1, 1, 1]), {"sample_dimension": "flag"}),
            "lat": Variable(("cast",), np.array([1.0, 2.0, 3.0])),
            "temp": Variable(("obs",), np.arange(5.0)),
            "f": Variable(("flag",), np.arange(3)),
        },
    )
    got = rows(ds)
    assert [(r["lat"], r["temp"], r["f"]) for r in got] == [(1, 0, 0), (1, 1, None), (2, None, 1), (3, 2, 2), (3, 3, None), (3, 4, None)]
    with pytest.raises(GridError):
        rows(ds, None, ["obs"])
    ds.variables["n"].values = np.array([-1, 0, 3])
    with pytest.raises(ValueError, match="negative"):
        rows(ds)


def test_netcdf_round_trip():
    ds = shaped()
    ds.variables["name"] = Variable(("lat",), np.array(["a", "bcé", ""]))
    back = netcdf3.parse(netcdf3.write(ds))
    assert back.attrs == {"title": "cube"} and {d: back.dims[d] for d in ds.dims} == ds.dims
    assert [r["name"] for r in rows(back, ["name"])] == ["a", "bcé", ""]
    assert rows(back, ["sst", "lat"]) == rows(ds, ["sst", "lat"])
    with pytest.raises(ValueError, match="HDF5"):
        netcdf3.parse(b"\x89HDF1234")


def test_zarr_unwritten_chunks_read_the_fill_value():
    meta = {"zarr_format": 3, "node_type": "array", "shape": [3, 4], "data_type": "float32", "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": [2, 2]}}, "chunk_key_encoding": {"name": "default", "configuration": {"separator": "/"}}, "fill_value": 7.0, "codecs": [{"name": "bytes", "configuration": {"endian": "little"}}, {"name": "gzip"}], "attributes": {"units": "K"}, "dimension_names": ["y", "x"]}
    block = zlib.compress(np.arange(4, dtype="<f4").tobytes(), wbits=31)
    ds = formats.zarr({"zarr.json": json.dumps({"zarr_format": 3, "node_type": "group", "attributes": {"t": 1}}).encode(), "v/zarr.json": json.dumps(meta).encode(), "v/c/0/1": block})
    assert ds.variables["v"].values.tolist() == [[7, 7, 0, 1], [7, 7, 2, 3], [7, 7, 7, 7]] and ds.dims == {"y": 3, "x": 4}


def tiny_tiff(compress):
    data = np.arange(6, dtype="<u2")
    raw = zlib.compress(data.tobytes()) if compress else data.tobytes()
    tags = [(256, 3, 3), (257, 3, 2), (258, 3, 16), (259, 3, 8 if compress else 1), (273, 4, 8), (277, 3, 1), (278, 3, 2), (279, 4, len(raw))]
    at = 8 + len(raw)
    at += at % 2
    head = b"II*\0" + struct.pack("<I", at) + raw + b"\0" * ((8 + len(raw)) % 2)
    return head + struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", t, k, 1, v) for t, k, v in tags) + b"\0" * 4


@pytest.mark.parametrize("compress", [False, True])
def test_tiff_pixels(compress):
    got = rows(formats.tiff(tiny_tiff(compress)))
    assert [r["band.0"] for r in got] == list(range(6)) and got[0]["image.width"] == 3 and got[0]["image.height"] == 2


ODV = '//<Encoding>UTF-8</Encoding>\n//<MetaVariable>label="Cruise" value_type="INDEXED_TEXT" qf_schema="S"</MetaVariable>\n//<DataVariable>label="Depth [m]" value_type="FLOAT"</DataVariable>\n' + "Cruise\tStation\tyyyy-mm-ddThh:mm:ss.sss\tDepth\nC1\tS1\t2020-01-01T00:00:00.000\t0.5\n\t\t\t\n"


def test_odv_keeps_metadata_null_unless_asked():
    got = formats.odv(ODV.encode()).to_pylist()
    assert got[0]["Cruise"] == "C1" and got[1]["Cruise"] is None and got[0]["Depth"] == 0.5 and got[1]["Depth"] is None
    assert got[0]["Depth.units"] == "m" and got[0]["Cruise.qf_schema"] == "S"
    assert formats.odv(ODV.encode(), fill_down=True).to_pylist()[1]["Cruise"] == "C1"
