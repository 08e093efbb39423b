"""File scans, decoders of response bodies, and a paged HTTP source."""
