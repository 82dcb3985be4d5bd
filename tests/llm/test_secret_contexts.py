"""Credentials after a scheme word, and after the assignments of several languages."""

import pytest

from scatterwave.llm import secrets

VALUE = "hT3kLm9Qz!xP2wR7"


@pytest.mark.parametrize(
    "before",
    ["Authorization: Bearer ", "authorization: Basic ", "Authorization: token ", "curl -H 'Bearer ", "'Authorization': 'Bearer ", "bearer: ", "password := ", "password == ", "password === ", "token => ", "pwd is ", "secret=", "password : "],
)
def test_value_is_found(before):
    text = f"x {before}{VALUE} y"
    at = text.index(VALUE)
    assert secrets.guessed_spans(text) == [(at, at + len(VALUE), 3)]


def test_plain_prose_is_not():
    assert secrets.guessed_spans("the bearer of bad news took a basic approach; Basic password password, bearer 20240131") == []
