from __future__ import annotations

import oracle
import pytest

from pairloom.llm import oracles, registry


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    assert oracle.differences(registry.queries()[name], registry.oracle_sql()[name], spark) == ""


def test_crc_by_half_bytes():
    import zlib

    steps = oracles.crc_steps()
    for raw in (b"", b"a", "né".encode(), bytes(range(256))):
        c = 0xFFFFFFFF
        for b in raw:
            for half in (b & 15, b >> 4):
                c = steps[(c ^ half) & 15] ^ c >> 4
        assert c ^ 0xFFFFFFFF == zlib.crc32(raw)
