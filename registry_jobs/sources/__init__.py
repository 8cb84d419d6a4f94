"""Tables, submissions and exports."""
