"""Column rules."""

from delimlake.functions.columns import error_message, friendly_amount, is_success, local_timestamp, parse_payload, split_responses

__all__ = ["error_message", "friendly_amount", "is_success", "local_timestamp", "parse_payload", "split_responses"]
