"""Reasoners: language models behind one small interface, the protocols that ask them, and the driver that runs a protocol over a frame of mentions."""
