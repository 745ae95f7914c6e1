"""Where rows come from and go to: files by content, reference tables, event logs, reports."""
