"""Scored scans, fusion, expansion, reranking, graph and evaluation operators."""
