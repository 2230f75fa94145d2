from tamis.streaming.moderate import moderate_stream, moderate_stream_history, moderate_stream_reload, run_available_now
from tamis.streaming.quota import quota_audit, quota_audit_stream, TokenBucket

__all__ = ["moderate_stream", "moderate_stream_history", "moderate_stream_reload", "run_available_now", "quota_audit",
           "quota_audit_stream", "TokenBucket"]
