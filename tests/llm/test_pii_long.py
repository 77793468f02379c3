"""Secrets of any length are proposed whole."""

from rowloom.llm import pii


def test_long_secrets():
    token = "".join("aZ3kQ9xLw7Pt"[k * k % 12] + str(k % 10) for k in range(200))
    text, run = f"api_key={token} end", "0123456789abcdef" * 30
    spans = [(k, a, b) for k, a, b, _ in pii.scan(text)[1]]
    assert ("secret", text.index(token), text.index(token) + len(token)) in spans
    assert ("secret", 4, 4 + len(run)) in [(k, a, b) for k, a, b, _ in pii.scan(f"see {run} .")[1]]
