"""Readers: files or tables of texts to lines."""

from delimlake.sources.lines import document_blocks, document_lines, scan_documents, scan_lines

__all__ = ["document_blocks", "document_lines", "scan_documents", "scan_lines"]
