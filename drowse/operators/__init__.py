"""DataFrame operators; keys are series_id and step unless said otherwise."""
