"""The driver gives back what its steps no longer need, so that a chain of operators doesn't pile it up."""

import ctypes
import re
import sys

import pytest

from spreadrank.llm.common import release


def anon_mb() -> float:
    return int(re.search(r"RssAnon:\s+(\d+)", open("/proc/self/status").read())[1]) / 1024


@pytest.mark.skipif(not sys.platform.startswith("linux") or not hasattr(ctypes.CDLL(None), "malloc_trim"), reason="another C library")
def test_release_gives_freed_memory_back(spark):
    libc, size = ctypes.CDLL(None), 1 << 16
    libc.malloc.restype, libc.malloc.argtypes, libc.free.argtypes = ctypes.c_void_p, [ctypes.c_size_t], [ctypes.c_void_p]
    blocks = [libc.malloc(size) for _ in range(3000)]
    for b in blocks:
        ctypes.memset(b, 1, size)
    for b in blocks[:-1]:  # the last one keeps the C library from giving back the others
        libc.free(b)
    before = anon_mb()
    release(spark)
    assert anon_mb() < before - 100
    libc.free(blocks[-1])
