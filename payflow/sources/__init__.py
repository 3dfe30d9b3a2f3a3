"""Readers (typed CSV, extended-JSON documents, CDC, FX payloads, XML, binary files) and sinks."""
