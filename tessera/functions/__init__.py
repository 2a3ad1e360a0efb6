"""Column functions: normalizers, pre-tokenizers, post-processors, decoders, array helpers."""
