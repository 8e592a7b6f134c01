"""Tables, snapshots, physical layout, dated drops and the order book."""
