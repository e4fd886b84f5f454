"""Report streams: idempotent upserts and scoring."""
