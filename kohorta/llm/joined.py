"""Chosen words of each text, joined by one space, as digests."""

from __future__ import annotations

import hashlib

import numpy as np

from kohorta.llm.wordbytes import Block


def joined_digests(block: Block, take: np.ndarray, doc: np.ndarray) -> list[str]:
    """sha256 (hex) for each text of ``block`` of the words ``take``, in that order.

    ``doc`` names the text that each taken word goes to and does not fall.
    """
    size = block.ends[take] - block.starts[take] + 1
    end = np.cumsum(size)
    at = np.repeat(block.starts[take] - (end - size), size) + np.arange(int(end[-1]) if len(end) else 0)
    data = np.append(block.data, np.uint8(32))[np.minimum(at, len(block.data))]
    data[end - 1] = 32
    raw = memoryview(np.ascontiguousarray(data))
    edge = np.searchsorted(doc, np.arange(block.n + 1))
    bounds = np.r_[0, end][edge]
    return [hashlib.sha256(raw[i : max(j - 1, i)]).hexdigest() for i, j in zip(bounds[:-1], bounds[1:], strict=True)]
