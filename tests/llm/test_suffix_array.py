import random
import time

from hypothesis import given, settings
from hypothesis import strategies as st

from lumenlog.llm.suffix_array import suffix_array


def brute(s):
    return sorted(range(len(s)), key=lambda i: s[i:])


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.binary(max_size=60), st.text("ab", max_size=60).map(str.encode), st.text("abc", max_size=90).map(str.encode)))
def test_is_the_sorted_order(s):
    assert suffix_array(s) == brute(s)


def test_shapes():
    rnd = random.Random(1)
    word = bytes(rnd.choices(b"ab", k=7))
    fib = [b"a", b"ab"]
    while len(fib[-1]) < 500:
        fib.append(fib[-1] + fib[-2])
    for s in (b"", b"a", b"a" * 300, b"ab" * 200, word * 50, fib[-1], bytes(range(256)), bytes(range(255, -1, -1)), b"\0x\0x\0x\0"):
        assert suffix_array(s) == brute(s)


def test_integers_and_linear_time():
    assert suffix_array([5, 1000, 5, 1000, 0]) == brute([5, 1000, 5, 1000, 0])
    for s in (b"a" * 200_000, b"ab" * 100_000):  # a quadratic method would not end here
        t = time.time()
        suffix_array(s)
        assert time.time() - t < 20
