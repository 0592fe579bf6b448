"""Where rows come from and go to: files, registered frames, and managed tables of three models."""
