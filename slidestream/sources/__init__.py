"""Inputs: sockets, replayed files, constants, tokens, generators."""
